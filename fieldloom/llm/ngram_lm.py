"""Language-model scores from a weighted backoff automaton over all documents.

The states of the automaton are the words seen in training, one for the start
of a text, and a root. A state has an arc for each word that followed it; for
any other word its failure arc leads to the root, which has an arc for every
word. With c for counts, N1(h) for the distinct words after h and discount D:

    arc h -> w      (c(h w) - D + D N1(h) P(w)) / c(h)
    failure of h    D N1(h) / c(h)
    root -> w       P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

so the weights out of a state sum to one. A text is read from left to right:
the state is the last word (the root, if training has not seen it), each word
adds the log weight of its arc, and the end is a word as well.

No task holds the whole automaton. A block of documents asks for the states
and arcs that its texts walk; groups of words, then of arcs, are counted over
all blocks; each block walks its own part. Words count by 64-bit hashes, and
arcs of a state by 48 bits of the following word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, fold, slices, written
from fieldloom.llm.packing import group_of, group_slices, pack, unpack, word_hashes

DISCOUNT = 0.75
#: Text of a block: its walk takes some twenty times as much memory.
BLOCK_BYTES = 9 << 20
FOLDS, HELD_FOLD = 10, 0
#: Keys counted in one group, about.
GROUP_KEYS = 1_500_000
#: A state with over 1 / HOT of all tokens is counted in SALTS groups.
HOT, SALTS = 4096, 64

_START = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xD1B54A32D192ED03)
_BLOCK = (
    "block long, n_train_docs long, n_train_words long, n_words long, n_vocab long, doc_ids array<long>,"
    " held array<boolean>, lengths array<long>, vocab binary, words binary, train binary"
)
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("n_train_docs", pa.int64()), ("n_train_words", pa.int64()), ("n_words", pa.int64()),
     ("n_vocab", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
     ("lengths", pa.list_(pa.int64())), ("vocab", pa.binary()), ("words", pa.binary()), ("train", pa.binary())]
)
#: Asks and answers of both levels: level 1 for words, level 2 for arcs.
_ASK = "block long, part long, keys binary, states binary, repeats binary, counts binary"
_ANSWER = "block long, part long, level long, totals binary, followers binary, hot_states binary, hot_values binary, distinct long, total long"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(block_bytes: int):
    """mapInArrow function: documents in blocks, as numbers of the block's sorted words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        ids, held, rows, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            hashes = word_hashes(list(known))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(hashes), np.uint32)
            place[order] = np.arange(len(hashes), dtype=np.uint32)
            words = place[np.concatenate(rows)] if rows else np.zeros(0, np.uint32)
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            learnt = np.repeat(~np.array(held, bool), lengths)
            train = np.bincount(words[learnt], minlength=len(hashes)).astype(np.uint32)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "block": (number << 32) + made, "n_train_docs": held.count(False),
                        "n_train_words": int(learnt.sum()), "n_words": len(words), "n_vocab": len(hashes),
                        "doc_ids": ids, "held": held, "lengths": lengths.tolist(),
                        "vocab": pack(hashes[order]), "words": pack(words), "train": pack(train),
                    }
                ],
                _BLOCK_ARROW,
            )

        for batch in slices(batches, "text"):
            columns = (batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist())
            for doc_id, out, text in zip(*columns, as_bytes(batch.column("text"))):
                words = text.lower().split()
                rows.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
                ids.append(doc_id)
                held.append(out)
                size += len(text)
                if size >= block_bytes:
                    yield block()
                    made += 1
                    known, ids, held, rows, size = {}, [], [], [], 0
        if ids:
            yield block()

    return blocks


def _word_asks(groups: int):
    def word_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocab, train = unpack(row["vocab"]), unpack(row["train"])
                yield from _asks(
                    (row["block"], g, pack(vocab[a:b]), None, None, pack(train[a:b]))
                    for g, a, b in group_slices(vocab, groups)
                )

    return word_asks


def _asks(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    if rows:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        names = ["block", "part", "keys", "states", "repeats", "counts"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)


class _Walk:
    """The steps of a block's texts, and the distinct arcs among them in asking order."""

    def __init__(self, row: dict, hot: np.ndarray, groups: int):
        vocab, words = unpack(row["vocab"]), unpack(row["words"]).astype(np.int64)
        lengths = np.array(row["lengths"], np.int64) + 1
        self.starts = np.cumsum(lengths) - lengths
        ends = self.starts + lengths - 1
        steps, outside = int(lengths.sum()), len(vocab)
        inside = np.ones(steps, bool)
        inside[ends] = False
        word = np.full(steps, outside, np.int64)
        word[inside] = words
        inside[ends], inside[self.starts] = True, False
        state = np.full(steps, outside, np.int64)
        state[inside] = words
        self.word = word
        arcs, self.arc_of = np.unique(state * (outside + 1) + word, return_inverse=True)
        learnt = np.repeat(~np.array(row["held"], bool), lengths)
        counts = np.bincount(self.arc_of[learnt], minlength=len(arcs)).astype(np.uint32)
        self.state, self.arc_word = arcs // (outside + 1), arcs % (outside + 1)
        states = np.append(vocab, _START)[self.state]
        follow = np.append(vocab, _END)[self.arc_word]
        # A hot state's arcs are dealt by the word as well.
        salt = np.where(np.isin(states, hot), follow % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
        route = np.where(salt > 0, mix(states + salt * _START), states)
        follow = follow >> np.uint64(16)
        part = group_of(route, groups)
        self.order = np.lexsort((follow, states, part))
        self.part, self.states = part[self.order].astype(np.int64), states[self.order]
        self.follow, self.counts = follow[self.order], counts[self.order]

    def asks(self, block: int) -> Iterator[tuple]:
        edges = np.flatnonzero(np.diff(self.part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(self.part)]):
            states, repeats = _runs(self.states[a:b])
            yield (block, int(self.part[a]), pack(self.follow[a:b]), pack(states),
                   pack(repeats.astype(np.uint32)), pack(self.counts[a:b]))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array, and how often each is there."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1))
    return sorted_values[edges], np.diff(np.append(edges, len(sorted_values)))


def _arc_asks(hot: np.ndarray, groups: int):
    def arc_asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _asks(_Walk(row, hot, groups).asks(row["block"]))

    return arc_asks


def _answer(asks: pa.Table, level: int, totals: list, followers: list, rest: dict) -> pa.Table:
    """The answers, and one row (block null) of what the group knows beyond them."""
    n = asks.num_rows
    rest = {"hot_states": None, "hot_values": None, "distinct": None, "total": None} | rest
    columns = {
        "block": pa.array([*asks.column("block").to_pylist(), None], pa.int64()),
        "part": pa.array([*asks.column("part").to_pylist(), None], pa.int64()),
        "level": pa.array([level] * (n + 1), pa.int64()),
        "totals": pa.array([*totals, None], pa.binary()),
        "followers": pa.array([*followers, None], pa.binary()),
    }
    for name, kind in (("hot_states", pa.binary()), ("hot_values", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())):
        columns[name] = pa.array([None] * n + [rest[name]], kind)
    return pa.table(columns)


def _count_words(n_tokens: int):
    """applyInArrow function: training counts of one group of words over all blocks."""

    def count_words(asks: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in asks.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x) for x in asks.column("counts").to_pylist()])
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(of, weights=counts, minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        answers = [pack(totals[x]) for x in np.split(of, ends[:-1])]
        hot = totals * np.uint64(HOT) > np.uint64(n_tokens)
        rest = {
            "hot_states": pack(distinct[hot]), "hot_values": pack(totals[hot]),
            "distinct": int((totals > 0).sum()), "total": int(totals.sum()),
        }
        return _answer(asks, 1, answers, [None] * len(keys), rest)

    return count_words


def _count_arcs(hot: np.ndarray):
    """applyInArrow function: training counts of one group of arcs, and the distinct arcs of states."""

    def count_arcs(asks: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in asks.column("keys").to_pylist()]
        own = [unpack(x) for x in asks.column("states").to_pylist()]
        repeats = [unpack(x) for x in asks.column("repeats").to_pylist()]
        counts = np.concatenate([unpack(x) for x in asks.column("counts").to_pylist()])
        states = np.repeat(np.concatenate(own), np.concatenate(repeats))
        arcs = mix(mix(states) + np.concatenate(keys))
        _, first, of = np.unique(arcs, return_index=True, return_inverse=True)
        totals = np.bincount(of, weights=counts, minlength=len(first)).astype(np.uint64)
        seen, n_followers = np.unique(states[first[totals > 0]], return_counts=True)
        ends = np.cumsum([len(k) for k in keys])
        answers = [pack(totals[x]) for x in np.split(of, ends[:-1])]

        def followers(some: np.ndarray) -> np.ndarray:
            if not len(seen):
                return np.zeros(len(some), np.uint64)
            at = np.minimum(np.searchsorted(seen, some), len(seen) - 1)
            return np.where(seen[at] == some, n_followers[at], 0).astype(np.uint64)

        salted = np.isin(seen, hot)
        rest = {"hot_states": pack(seen[salted]), "hot_values": pack(n_followers[salted].astype(np.uint64))}
        return _answer(asks, 2, answers, [pack(followers(x)) for x in own], rest)

    return count_arcs


def _hot(answers: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hot states and their values over all groups: at most HOT states and the start."""
    rows = answers.where("block is null").select("hot_states", "hot_values").collect()
    none = [np.zeros(0, np.uint64)]
    states = np.concatenate([unpack(r[0]) for r in rows] or none)
    distinct, of = np.unique(states, return_inverse=True)
    values = np.concatenate([unpack(r[1]) for r in rows] or none)
    return distinct, np.bincount(of, weights=values, minlength=len(distinct))


def _score(hot: np.ndarray, hot_followers: dict[int, float], groups: int, known: dict):
    """cogroup function on a block and its answers: walks the block's texts."""
    n_docs, n_tokens, n_distinct, discount = (known[k] for k in ("docs", "tokens", "distinct", "discount"))

    def parts(answers: list[dict], level: int, column: str) -> np.ndarray:
        own = sorted((a["part"], a[column]) for a in answers if a["level"] == level)
        return np.concatenate([unpack(x) for _, x in own] or [np.zeros(0, np.uint64)]).astype(float)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict = {n: [] for n in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        if block.num_rows:
            row, answers = block.to_pylist()[0], answers.to_pylist()
            walk = _Walk(row, hot, groups)
            counts = np.append(parts(answers, 1, "totals"), float(n_docs))  # the last: start and end
            if len(counts) != row["n_vocab"] + 1:
                raise ValueError("a block and its answers do not fit")
            chance = (counts + 0.1) / (n_tokens + 0.1 * (n_distinct + 1))
            state, word = walk.state[walk.order], walk.arc_word[walk.order]
            own, repeats = _runs_by_part(walk)
            followers = parts(answers, 2, "followers")
            followers = np.array([hot_followers.get(int(s), f) for s, f in zip(own, followers)])
            followers = np.repeat(followers, repeats)
            seen = parts(answers, 2, "totals")
            of_state = counts[state]
            arc = np.where(seen > 0, seen - discount, 0.0) + discount * followers * chance[word]
            arc = np.where(of_state > 0, arc / np.maximum(of_state, 1.0), chance[word])
            weight = np.empty(len(arc))
            weight[walk.order] = np.log10(arc)
            out = {
                "doc_id": row["doc_ids"],
                "held_out": row["held"],
                "n_tokens": np.array(row["lengths"], np.int64) + 1,
                "n_known": np.add.reduceat((counts > 0)[walk.word].astype(np.int64), walk.starts),
                "base_score": np.add.reduceat(np.log10(chance)[walk.word], walk.starts),
                "score": np.add.reduceat(weight[walk.arc_of], walk.starts),
            }
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return score


def _runs_by_part(walk: _Walk) -> tuple[np.ndarray, np.ndarray]:
    """States of the asks, in their order, and how many arcs each asks for."""
    fresh = (np.diff(walk.states) != 0) | (np.diff(walk.part) != 0)
    edges = np.concatenate(([0], np.flatnonzero(fresh) + 1))
    return walk.states[edges], np.diff(np.append(edges, len(walk.states)))


def lm_scores(
    docs: DataFrame, discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its log10 probability.

    Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    root's arcs alone) and score (the automaton's). Training leaves out the
    documents whose crc32(doc_id) modulo 10 is 0 (held_out); a null doc_id
    trains. Null and empty texts are the end token alone. Repeated rows count
    as often as they are there; other columns are left aside. Without training
    documents every probability is the base's. An empty table gives an empty
    table.
    """
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_FOLD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    table = written(rows.mapInArrow(_blocks(block_bytes), _BLOCK), "blocks")
    sums = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train_docs", "n_train_words", "n_words", "n_vocab")))
    n_docs, n_words, walked, asked = sums.first()
    n_tokens = n_docs + n_words
    word_groups, arc_groups = (max(12, -(-n // GROUP_KEYS)) for n in (asked, walked))

    asks = table.select("block", "vocab", "train").mapInArrow(_word_asks(word_groups), _ASK)
    words = written(asks.groupBy("part").applyInArrow(_count_words(n_tokens), _ANSWER), "words")
    n_distinct = words.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + (n_docs > 0)
    hot = np.unique(np.append(_hot(words)[0], _START))

    walks = table.select("block", "held", "lengths", "vocab", "words")
    asks = walks.mapInArrow(_arc_asks(hot, arc_groups), _ASK)
    arcs = written(asks.groupBy("part").applyInArrow(_count_arcs(hot), _ANSWER), "arcs")
    followers = dict(zip(*(x.tolist() for x in _hot(arcs))))
    followers = {int(s): followers.get(s, 0.0) for s in hot.tolist()}

    columns = ["block", "part", "level", "totals", "followers"]
    answers = words.select(columns).union(arcs.select(columns)).where("block is not null")
    known = {"docs": n_docs, "tokens": n_tokens, "distinct": n_distinct, "discount": discount}
    blocks = table.select("block", "n_vocab", "doc_ids", "held", "lengths", "vocab", "words")
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(
            _score(hot, followers, arc_groups, known),
            "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
        .withColumn("train_tokens", F.lit(n_tokens).cast("long"))
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    )
