"""Best-fit packing of token sequences by minimum bin slack.

Documents are cut into pieces of at most the capacity, and pieces are put
together into sequences. Fleszar and Hindi, "New heuristics for one-dimensional
bin-packing" (2002): a bin takes the largest piece that is left and the
combination of others that leaves the least slack; then it is closed. Here the
combination is found by subset sums over the lengths that are left, as bits of
one integer.

Pieces of one length are alike, so the packing depends on the counts of the
lengths alone: at most as many numbers as the capacity, however large the
corpus. A combination is taken as often as the counts allow at once, which is
what bin after bin would do, as it stays the fullest while it is feasible. The
plan hands out ranges of ranks within a length; ranks come from prefix sums
over the tasks that cut the pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, slices, written
from fieldloom.llm.token_files import END_ID, id_type
from fieldloom.llm.tokenizing import word_encoder

CAPACITY = 4096

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def _cut(path: str, dtype: str, end_id: int, capacity: int, with_ids: bool):
    """mapInArrow function: texts to pieces, each with its place among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = word_encoder(path, dtype), TaskContext.get().partitionId()
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        seen: dict[int, int] = {}
        for batch in slices(batches, "text"):
            rows, parts = [], []
            encoded = encoder.encode(as_bytes(batch.column("text")))
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded):
                data += end
                for piece, at in enumerate(range(0, len(data), capacity * width)):
                    part = data[at : at + capacity * width]
                    length = len(part) // width
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    crc = zlib.crc32(np.frombuffer(part, dtype).astype("<u4"))
                    rows.append((doc_id, piece, at // width, length, crc, task, nth))
                    if with_ids:
                        parts.append(part)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            names = [c.split()[0] for c in _PIECE.split(", ")]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), written: doc_id, piece, start, length, ids_crc32, task, nth.

    ``task`` and ``nth`` number the pieces of one length; ``with_ids`` adds the
    ids themselves, as little-endian unsigned integers of the vocabulary's width.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    cut = _cut(path, id_type(path, end_id), end_id, capacity, with_ids)
    return written(rows.mapInArrow(cut, _PIECE + ", ids binary" * with_ids), "pieces")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of ``lengths`` (descending, each ``counts`` times) that fills ``room`` best.

    Bit k of ``reach`` says whether k can be made of the lengths so far. The
    larger lengths come first, and the search ends as soon as the room is full,
    so small pieces are kept for later bins.
    """
    reach, full, within, steps = 1, 1 << room, (1 << room + 1) - 1, []
    for length in lengths:
        left, take = min(counts[length], room // length), 1
        while left > 0:  # one, two, four... of them make up every number of them
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & within
            left, take = left - take, take * 2
        if reach & full:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[dict[int, int], int]]:
    """(combination of lengths, number of bins that take it) until all pieces are packed.

    Each step uses up a length but for less than its share of one bin, so there
    are at most capacity * (1 + log capacity) steps.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    rising = sorted(left)
    while rising:
        largest = rising[-1]
        room = capacity - largest
        left[largest] -= 1
        falling = rising[bisect_left(rising, room + 1) - 1 :: -1] if rising[0] <= room else []
        chosen = fullest(falling, left, room)
        left[largest] += 1
        chosen[largest] = chosen.get(largest, 0) + 1
        times = min(left[length] // n for length, n in chosen.items())
        yield chosen, times
        for length, n in chosen.items():
            left[length] -= n * times
            if not left[length]:
                del left[length], rising[bisect_left(rising, length)]


_PLAN = "length long, low long, high long, first_bin long, share long, place long"


def _plan(capacity: int):
    """mapInArrow function over all rows (length, n): ranges of ranks and the bins they go to."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {r["length"]: r["n"] for b in batches for r in b.to_pylist()}
        used, bins, out = dict.fromkeys(counts, 0), 0, []
        for chosen, times in bin_plan(counts, capacity):
            place = 0
            for length in sorted(chosen, reverse=True):
                n, low = chosen[length], used[length]
                used[length] = low + n * times
                out.append((length, low, used[length], bins, n, place))
                place += n * length
            bins += times
        if out:
            names = [c.split()[0] for c in _PLAN.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return plan


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with length, task and nth (place among the task's rows of a length).

    Offsets of a sequence are gapless from 0, and its lengths sum up to
    ``capacity`` at most. All columns but task and nth are kept.
    """
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))  # one row for each length at most
    plan = written(totals.coalesce(1).mapInArrow(_plan(capacity), _PLAN), "plan")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The ranges of the plan that a task's pieces of a length fall into.
    inside = (F.col("low") < F.col("base") + F.col("n")) & (F.col("high") > F.col("base"))
    ranges = bases.join(plan, "length").where(inside).drop("n")
    rank = F.col("base") + F.col("nth")
    nth = rank - F.col("low")
    return (
        cut.join(ranges, ["task", "length"])
        .where((rank >= F.col("low")) & (rank < F.col("high")))
        .withColumn("sequence_id", F.col("first_bin") + F.floor(nth / F.col("share")))
        .withColumn("offset", F.col("place") + nth % F.col("share") * F.col("length"))
        .select(*(c for c in cut.columns if c not in ("task", "nth")), "sequence_id", "offset")
    )


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where each piece of ``docs`` (doc_id, text) lies among the packed sequences.

    Columns doc_id, piece (from 0), start (ids of the document before it),
    length, ids_crc32 (of the ids as unsigned 32-bit integers), sequence_id,
    offset. Whole texts are encoded without special tokens around them and end
    with ``end_id``; null and empty texts are that id alone. Only documents over
    ``capacity`` are cut. Every row of a doc_id, or of none, is a document of its
    own. Other columns are left aside. An empty table gives an empty table.
    """
    return placed(pieces(docs, path, capacity, end_id), capacity)


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids, doc_ids and offsets of their pieces.

    ids are little-endian unsigned integers (16 bits if the vocabulary allows,
    else 32). A sequence has ``capacity`` pieces at most, of ``capacity`` ids together.
    """
    rows = placed(pieces(docs, path, capacity, end_id, with_ids=True), capacity)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return rows.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id",
        F.aggregate("held", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.unhex(F.array_join(F.transform("held", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.col("held.doc_id").alias("doc_ids"),
        F.col("held.offset").alias("offsets"),
    )
