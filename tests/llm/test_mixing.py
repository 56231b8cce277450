"""The mix against its targets, computed step by step."""

import re
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import mixing
from fieldloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, found):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    target = plain_targets(sizes)
    largest = Counter()
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert sorted((str(r["doc_id"]), words(r["text"])) for r in rows) == sorted((str(r.doc_id), r.size) for r in found)


@pytest.mark.parametrize("bucket,fan_in", [(4096, 1024), (3, 2)])
def test_targets_and_reruns(spark, make, bucket, fan_in):
    rows = [r.asDict() for r in documents(spark, SMALL).select("doc_id", "text", "source").collect()]
    rows += [{"doc_id": 5000 + i, "text": "w " * (i % 37), "source": s} for i in range(400) for s in ["hot"] + [None] * (i < 40)]
    rows += [{"doc_id": 7, "text": t, "source": s} for t in (None, "", "a b c\x0bd") for s in (None, "empty", "Ä", "hot")]
    rows += [{"doc_id": None, "text": "no id at all", "source": "hot"}] * 3
    docs = make(rows)
    first = mixing.copies(docs, bucket=bucket, fan_in=fan_in).collect()
    check(rows, first)
    again = mixing.copies(docs.repartition(7, "text"), bucket=bucket, fan_in=fan_in).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mixture_repeats_rows(make):
    rows = [{"doc_id": i, "text": "w " * (i % 9 + 1), "source": f"s{i % 3}"} for i in range(90)] + [
        {"doc_id": 1, "text": "w w ", "source": "s1"}, {"doc_id": None, "text": "x", "source": None}
    ]
    docs = make(rows)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    wanted = Counter()
    for r in mixing.copies(docs).collect():
        wanted[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +wanted


def test_rounding_keeps_words_and_expectations():
    rng = np.random.default_rng(1)
    size, part = rng.integers(1, 50, 60).astype(float), rng.random(60)
    draws = np.array([mixing.round_pairs(size, part, np.random.default_rng(i)) for i in range(4000)])
    assert np.abs(draws @ size - part @ size).max() < 1e-6
    assert (((draws > 0) & (draws < 1)).sum(axis=1) <= 1).all()
    assert np.abs(draws.mean(axis=0) - part).max() < 0.04


def test_empty_table(make):
    assert mixing.copies(make([])).count() == 0
    assert mixing.mixture(make([])).count() == 0
