"""Token counts without ids: pieces once per distinct pre-token, then sums.

A block of documents keeps, for each document, its distinct pre-tokens and how
often they occur. Each block asks once for each of its pre-tokens; a group of
pre-tokens meets in one task, where each distinct one is encoded once. The
answers join the blocks, and every document sums frequency times pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, slices, written
from fieldloom.llm.packing import BLOCK_BYTES, group_slices, pack, unpack, word_hashes
from fieldloom.llm.tokenizing import pre_tokens

#: Text per group of pre-tokens: sets how many groups there are.
GROUP_BYTES = 24 << 20
LIMIT = 512

_BLOCK = (
    "block long, part int, words binary, n_words long, doc_ids array<long>,"
    " n_bytes array<long>, n_distinct array<long>, entries binary, counts binary"
)
_BLOCK_ARROW = pa.schema(
    [
        ("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("n_words", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
        ("n_distinct", pa.list_(pa.int64())), ("entries", pa.binary()), ("counts", pa.binary()),
    ]
)


def _pack_words(words: list[bytes]) -> bytes:
    """A list of byte strings: their lengths, then their bytes."""
    lengths = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    joined = b"".join(words)
    body = pa.compress(joined, codec="zstd", asbytes=True)
    return b"".join([len(lengths).to_bytes(8, "little"), lengths, len(joined).to_bytes(8, "little"), body])


def _unpack_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unpack(data[8:at]), dtype=np.int64).tolist()
    size = int.from_bytes(data[at : at + 8], "little")
    joined = pa.decompress(data[at + 8 :], size, codec="zstd", asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def _blocks(path: str, groups: int, block_bytes: int):
    """mapInArrow function: rows of blocks (part null) and of their asks (part set)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, made = TaskContext.get().partitionId(), 0
        cut, known = pre_tokens(path), {}
        ids, sizes, distinct, entries, counts = [], [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            block = (number << 32) + made
            made += 1
            words = list(known)
            hashes = word_hashes(words)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            rows = []
            for g, a, b in group_slices(hashes[order], groups):
                chosen = [words[i] for i in order[a:b].tolist()]
                rows.append({"block": block, "part": g, "words": _pack_words(chosen), "n_words": b - a})
            flat = place[np.fromiter(entries, np.int64, len(entries))]
            # Each document's entries in ascending order, as steps: these pack well.
            lengths = np.array(distinct, np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((flat, owner))
            steps = flat[order].astype(np.int64)
            steps[1:] -= np.where(owner[1:] == owner[:-1], steps[:-1], 0)
            rows.append(
                {
                    "block": block, "n_words": len(words), "doc_ids": ids[:], "n_bytes": sizes[:],
                    "n_distinct": distinct[:], "entries": pack(steps.astype(np.uint32)),
                    "counts": pack(np.array(counts, np.uint32)[order]),
                }
            )
            yield pa.RecordBatch.from_pylist(rows, _BLOCK_ARROW)
            for held in (known, ids, sizes, distinct, entries, counts):
                held.clear()

        held = 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                found = cut(text)
                entries.extend([known.setdefault(w, len(known)) for w in found])
                counts.extend(found.values())
                ids.append(doc_id)
                sizes.append(len(text))
                distinct.append(len(found))
                held += len(text)
                if held >= block_bytes:
                    yield from flush()
                    held = 0
        if ids:
            yield from flush()

    return blocks


def _count_pieces(path: str):
    """applyInArrow function on one group of pre-tokens: pieces of each ask, in its order."""

    def count_pieces(asks: pa.Table) -> pa.Table:
        words = [_unpack_words(x) for x in asks.column("words").to_pylist()]
        pieces: dict[bytes, int] = dict.fromkeys(w for ask in words for w in ask)
        distinct = list(pieces)
        pieces.update(zip(distinct, pre_tokens(path).piece_counts(distinct)))
        answers = [
            pack(np.fromiter(map(pieces.__getitem__, ask), np.uint32, len(ask))) for ask in words
        ]
        return pa.table(
            {"block": asks.column("block"), "part": asks.column("part"), "pieces": pa.array(answers, pa.binary())}
        )

    return count_pieces


def _sum_pieces(block: pa.Table, answers: pa.Table) -> pa.Table:
    """cogroup function on a block and its answers: tokens of each document."""
    out = {"doc_id": [], "n_bytes": [], "n_tokens": []}
    if block.num_rows:
        row = block.to_pylist()[0]
        found = sorted(zip(answers.column("part").to_pylist(), answers.column("pieces").to_pylist()))
        pieces = np.concatenate([unpack(x).astype(np.int64) for _, x in found] or [np.zeros(0, np.int64)])
        if len(pieces) != row["n_words"]:
            raise ValueError("a block and its answers do not fit")
        lengths = np.array(row["n_distinct"], np.int64)
        ends = np.cumsum(lengths)
        steps = unpack(row["entries"]).astype(np.int64)
        # Steps of each document add up to its entries; the sums before it are taken off.
        running = np.cumsum(steps)
        starts = ends - lengths
        before = np.where(starts > 0, running[np.maximum(starts, 1) - 1] if len(running) else 0, 0)
        entries = running - np.repeat(before, lengths)
        tokens = np.concatenate(([0], np.cumsum(pieces[entries] * unpack(row["counts"]))))
        out = {"doc_id": row["doc_ids"], "n_bytes": row["n_bytes"], "n_tokens": tokens[ends] - tokens[starts]}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizer at ``path`` for the whole text, without
    special tokens around it; special strings in a text count as the library
    has them. Null and empty texts count 0. Repeated rows and null doc_ids are
    rows like others; other columns are left aside. An empty table gives an
    empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(12, -(-size // GROUP_BYTES))
    table = written(rows.mapInArrow(_blocks(path, groups, block_bytes), _BLOCK), "pretokens")
    answers = (
        table.where("part is not null")
        .select("block", "part", "words")
        .groupBy("part")
        .applyInArrow(_count_pieces(path), "block long, part int, pieces binary")
    )
    blocks = table.where("part is null").select(
        "block", "n_words", "doc_ids", "n_bytes", "n_distinct", "entries", "counts"
    )
    summed = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return summed.applyInArrow(_sum_pieces, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
