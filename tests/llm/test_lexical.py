"""Ranked search against SQL on whole tables and plain counting on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
from compare import compare, connect
from fieldloom.llm import lexical_search

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    "alpha beta gamma", "Alpha ALPHA beta", "alpha beta gamma", "beta-delta_7 ÄRGER ärger", None, "", " \n\x00!~",
    "alpha " * 30_000, "gamma x gamma", "中文 beta", "zeta eta theta",
]
DOCS = [{"doc_id": 40 - i, "text": t} for i, t in enumerate(TEXTS)]
DOCS += [{"doc_id": None, "text": "alpha beta gamma"}, {"doc_id": 39, "text": "beta"}, {"doc_id": 40, "text": TEXTS[0]}]
ITEMS = [
    (1, "alpha beta"), (2, "Ärger 7 unknown"), (3, None), (4, ""), (5, "gamma"), (5, "gamma"), (5, "中文"),
    (None, "beta beta"), (6, "unknown words"), (7, " ".join(f"v{i}" for i in range(3000)) + " alpha zeta"),
]


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, top):
    held = [(d["doc_id"], Counter(terms(d["text"]))) for d in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    merged = {}
    for item_id, text in items:
        merged.setdefault(item_id, set()).update(terms(text))
    out = []
    for item_id, own in merged.items():
        scores = []
        for doc_id, c, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            weigh = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
            s = sum(weigh(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        for rank, (s, _, _, doc_id) in enumerate(sorted(scores, key=lambda x: x[:3])[:top], 1):
            out.append((item_id, rank, doc_id, -s))
    return sorted(out, key=str)


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("top", [50, 3, 1])
def test_odd_rows(spark, make, top):
    found = lexical_search.search(make(DOCS, "score string"), items(spark), top)
    assert sorted(map(tuple, found.collect()), key=str) == plain(DOCS, ITEMS, top)


def test_small_blocks_and_tiles(spark, make, monkeypatch):
    """Tiles of one document, blocks of two items, groups of one task."""
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    monkeypatch.setattr(lexical_search, "VOCABULARY", 5)
    monkeypatch.setattr(lexical_search, "DOC_TILE", 1)
    monkeypatch.setattr(lexical_search, "FAN_IN", 2)
    found = lexical_search.search(make(DOCS).repartition(5), items(spark), 2)
    assert sorted(map(tuple, found.collect()), key=str) == plain(DOCS, ITEMS, 2)


def test_partial_sums_stay_exact():
    """A vocabulary tile ends before its weights times the largest impact reach 2^53."""
    weights = np.full(700_000, 27_000, np.int64)
    (tile,) = lexical_search.item_tiles([np.arange(700_000)], weights, term_tile=1 << 20)
    sums = [int(weights[some].sum()) * lexical_search.MOST_IMPACT for some, _ in tile[1]]
    assert len(sums) == 3 and max(sums) < 1 << 53
    assert sum(len(places[0]) for _, places in tile[1]) == 700_000


def test_ties_across_tiles():
    best = lexical_search._Best(1, 2)
    for docs in ([9, 4], [7, 1], [3, 8]):
        best.offer(np.array([0]), np.array([[5, 5]]), np.array(docs), np.array([0, 0]))
        best.settle()
    assert best.held[3].tolist() == [1, 3]


def test_whole_table_equals_sql(spark):
    found = contract.queries()["op11_lexical_search"](spark, SMALL)
    assert compare(found, connect(SMALL), contract.oracle_sql()["op11_lexical_search"]) == []


def test_empty_tables(spark, make):
    assert lexical_search.search(make([]), items(spark)).count() == 0
    assert lexical_search.search(make(DOCS), items(spark, [])).count() == 0
    assert lexical_search.search(make([{"doc_id": 1, "text": "!"}]), items(spark)).count() == 0
