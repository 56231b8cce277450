"""Packing by minimum bin slack: subset sums, whole plans, and the pieces of real texts."""

import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import bin_slack
from fieldloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "<|endoftext|> x", "Ärger 中文 it's", "word, " * 9000, "word " * 4095, "word " * 4096, "tie", "tie",
]
ROWS = [{"doc_id": 50 - i, "text": t} for i, t in enumerate(TEXTS)]
ROWS += [{"doc_id": None, "text": "no id"}, {"doc_id": 42, "text": "tie"}, {"doc_id": 42, "text": "another"}]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 40))
def test_fullest_combination(counts, room):
    fitting = sorted((x for x in counts if x <= room), reverse=True)
    chosen = bin_slack.fullest(fitting, counts, room)
    assert all(n <= counts[x] for x, n in chosen.items())
    best = max(
        (s for s in (sum(x * n for x, n in zip(counts, ns)) for ns in product(*(range(c + 1) for c in counts.values()))) if s <= room),
        default=0,
    )
    assert sum(x * n for x, n in chosen.items()) == best


def bin_by_bin(counts, capacity):
    """One bin after the other, with nothing taken at once."""
    left, bins = Counter(counts), []
    while +left:
        largest = max(+left)
        left[largest] -= 1
        room = capacity - largest
        chosen = bin_slack.fullest(sorted((x for x in +left if x <= room), reverse=True), left, room)
        left -= Counter(chosen)
        bins.append(Counter(chosen) + Counter([largest]))
    return bins


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=8))
def test_plan_is_what_single_bins_would_take(counts):
    plan = list(bin_slack.bin_plan(dict(counts), 30))
    assert sum((Counter({x: n * times for x, n in c.items()}) for c, times in plan), Counter()) == Counter(counts)
    assert all(sum(x * n for x, n in c.items()) <= 30 for c, _ in plan)
    one_by_one = bin_by_bin(counts, 30)
    assert [Counter(c) for c, times in plan for _ in range(times)] == one_by_one


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_no_more_bins_than_best_fit():
    rng = np.random.default_rng(5)
    for high in (100, 60, 40):
        lengths = rng.integers(1, high + 1, 2000).tolist()
        bins = sum(times for _, times in bin_slack.bin_plan(Counter(lengths), 100))
        assert -(-sum(lengths) // 100) <= bins <= best_fit_decreasing(lengths, 100)


def test_large_counts_cost_nothing_more():
    many = {1: 10**12, 700: 10**11, 3000: 10**11, 4096: 10**10}
    plan = list(bin_slack.bin_plan(many))
    assert len(plan) < 30 and sum(times for _, times in plan) == many[3000] + many[4096]  # no two fit


def cut(rows, capacity):
    found = Tokenizer.from_file(WORDS).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)
    out = []
    for r, e in zip(rows, found):
        ids = np.array([*e.ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((r["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(found, rows, capacity=4096):
    """All pieces, once; sequences without gaps, not over the capacity. Gives their number."""
    assert sorted((tuple(r)[:5] for r in found), key=str) == cut(rows, capacity)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        spans.sort()
        assert [s for s, _ in spans] == np.cumsum([0] + [n for _, n in spans[:-1]]).tolist()
        assert sum(n for _, n in spans) <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [4096, 64, 1])
def test_odd_texts(make, capacity):
    rows = ROWS if capacity > 1 else ROWS[:5]
    found = bin_slack.packed_pieces(make(rows, "length string"), WORDS, capacity).collect()
    assert check(found, rows, capacity) == -(-sum(r.length for r in found) // capacity)


def test_whole_table(spark):
    docs = documents(spark, SMALL).repartition(7)
    rows = [r.asDict() for r in docs.select("doc_id", "text").collect()]
    found = bin_slack.packed_pieces(docs, WORDS).collect()
    assert check(found, rows) <= -(-sum(r.length for r in found) // 4096) + 1


def test_equal_lengths_over_many_tasks(make):
    rows = [{"doc_id": i, "text": "a" if i % 3 else ""} for i in range(900)]
    found = bin_slack.packed_pieces(make(rows).repartition(9), WORDS, 5).collect()
    assert check(found, rows, 5) == 300


def test_sequences_hold_the_ids_of_their_pieces(make):
    docs = make(ROWS)
    sequences = {r.sequence_id: r for r in bin_slack.packed_sequences(docs, WORDS, 64).collect()}
    assert all(len(r.ids) == 2 * r.n_tokens and len(r.doc_ids) == len(r.offsets) for r in sequences.values())
    found = []
    for r in sequences.values():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        for doc_id, a, b in zip(r.doc_ids, r.offsets, [*r.offsets[1:], r.n_tokens]):
            found.append((doc_id, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(found, key=str) == sorted(((d, n, c) for d, _, _, n, c in cut(ROWS, 64)), key=str)


def test_empty_table(make):
    assert bin_slack.packed_pieces(make([]), WORDS).count() == 0
    assert bin_slack.packed_sequences(make([]), WORDS).count() == 0
