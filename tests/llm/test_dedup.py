"""Exact and near duplicates against plain Python."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from fieldloom.llm import exact_dedup, simhash
from fieldloom.llm.common import documents
from fieldloom.llm.components import components

SMALL = "/root/testdata/sf0.001"


def plain_print(text):
    words = bytes(text or "", "utf8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=4):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


ODD = [
    {"doc_id": 5, "text": ""}, {"doc_id": 3, "text": None}, {"doc_id": 9, "text": " \t\n"},
    {"doc_id": 7, "text": "one two"}, {"doc_id": 8, "text": "ONE  two"}, {"doc_id": 8, "text": "ONE  two"},
    {"doc_id": None, "text": "one two"}, {"doc_id": None, "text": "lonely words of nobody here"},
    {"doc_id": 11, "text": "Ärger ärger Ünd x y"}, {"doc_id": 12, "text": "z" * 300_000},
    {"doc_id": 13, "text": "a b c d " * 40_000},
]


@pytest.mark.parametrize("tile", [4096, 8])
def test_near_duplicates_equal_brute_force(make, tile):
    rows = ODD + [{"doc_id": 100 + i, "text": t} for i, t in enumerate(near_texts(60, 1) + near_texts(20, 2))]
    found = simhash.near_duplicates(make(rows), tile=tile).collect()
    prints = [plain_print(r["text"]) for r in rows]
    expected = plain_components([r["doc_id"] for r in rows], prints)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, found), key=key) == sorted(
        ((r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, expected)), key=key
    )


def test_near_duplicates_of_a_whole_table(spark):
    docs = documents(spark, SMALL)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    expected = dict(zip((r.doc_id for r in rows), plain_components([r.doc_id for r in rows], prints)))
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(found) == len(rows)


def test_keep_first_keeps_one_row_of_each_group(make):
    docs = make(ODD)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    texts = sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect())
    assert texts == [("11", 19), ("12", 300_000), ("13", 320_000), ("3", 0), ("7", 7), ("None", 27)]


@pytest.mark.parametrize("n", [10, 10**8, 10**11, 10**14])
def test_block_choices_find_all_close_pairs(n):
    masks = simhash.block_masks(n, 4)
    rng = np.random.default_rng(n % 1000)
    for _ in range(300):
        a, flips = int(rng.integers(0, 2**63)), rng.choice(64, rng.integers(0, 5), replace=False)
        b = a
        for f in flips:
            b ^= 1 << int(f)
        assert any(a & m == b & m for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 1)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(make, digest_bytes):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000))
    rows = ODD + [{"doc_id": 20, "text": long}, {"doc_id": 21, "text": long}, {"doc_id": 22, "text": long[:-1]},
                  {"doc_id": 23, "text": "x" + long}, {"doc_id": 24, "text": long[:30_000] + "?" + long[30_001:]}]
    rows += [{"doc_id": 1000 + i, "text": f"text {i % 40}"} for i in range(80)]
    found = exact_dedup.exact_groups(make(rows), digest_bytes=digest_bytes).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    expected = []
    for r in rows:
        ids = groups[r["text"] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256((r["text"] or "").encode()).hexdigest()
        expected.append((r["doc_id"], keep, len(ids), r["doc_id"] == keep, sha))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_empty_tables(make):
    assert exact_dedup.exact_groups(make([])).count() == 0
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.keep_first(make([])).count() == 0


def test_keep_first_where_a_doc_id_stands_on_two_texts(make):
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    a1, a2, b1, b2 = " ".join(a), " ".join(a).upper(), " ".join(b), " ".join(b).upper()  # equal fingerprints
    rows = [(5, a1), (8, a2), (5, b1), (9, b2), (5, a1)]
    kept = simhash.keep_first(make([{"doc_id": d, "text": t} for d, t in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, a1), (5, b1)]
    kept = simhash.keep_first(make([{"doc_id": d, "text": t} for d, t in [(3, a1), (5, a2), (5, b1)]])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, a1), (5, b1)]
    twice = [{"doc_id": 5, "text": t, "source": s} for t in (a1, a2) for s in ("x", "y")]
    one, other = simhash.keep_first(make(twice)).collect(), simhash.keep_first(make(twice[::-1])).collect()
    assert len(one) == 1 and one == other
