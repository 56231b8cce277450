"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of the last 32 bytes is zero in its top
bits, so equal passages of different texts are cut alike. Chunks move through
one shuffle, in which equal digests are checked to have equal bytes; from then
on a text is the ordered list of its verified chunk identifiers, and only
these lists are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, slices, written

MIN_CHUNK = 256
MAX_CHUNK = 16384
#: A cut at one position in 2 ** CUT_BITS on average.
CUT_BITS = 10
DIGEST_BYTES = 16

_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def cut_candidates(data: np.ndarray, cut_bits: int) -> np.ndarray:
    """Positions after which a chunk may end, from the 32 bytes up to each."""
    rolled = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(rolled) > shift:
            before = rolled[:-shift] << np.uint32(shift)
            rolled[shift:] += before
    return np.flatnonzero(rolled >> np.uint32(32 - cut_bits) == 0) + 1


def chunk_bounds(start: int, end: int, candidates: list[int], at: int) -> tuple[list[int], int]:
    """Chunk ends of the text at [start, end); ``at`` walks over the candidates."""
    ends, last = [], start
    while last < end:
        least, most = last + MIN_CHUNK, min(last + MAX_CHUNK, end)
        while at < len(candidates) and candidates[at] < least:
            at += 1
        cut = candidates[at] if at < len(candidates) and candidates[at] < most else most
        ends.append(cut)
        last = cut
    return ends, at


def _chunked(batch: pa.RecordBatch, cut_bits: int) -> Iterator[tuple[bytes, list[int]]]:
    """Each text of a batch with the ends of its chunks."""
    texts = as_bytes(batch.column("text"))
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    candidates = cut_candidates(joined, cut_bits).tolist() if len(joined) else []
    start, at = 0, 0
    for text in texts:
        ends, at = chunk_bounds(start, start + len(text), candidates, at)
        yield text, [e - start for e in ends]
        start += len(text)


def _recipes(cut_bits: int, digest_bytes: int, contents: bool):
    """mapInArrow function: a row (doc_id, text_sha256, n_bytes, recipe) for each
    document, or rows (doc_id, text_sha256, position, digest, content) of chunks."""

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, (text, ends) in zip(ids, _chunked(batch, cut_bits)):
                parts = [text[a:b] for a, b in zip([0, *ends], ends)]
                digests = [xxhash.xxh3_128_digest(x)[:digest_bytes] for x in parts]
                sha = hashlib.sha256(text).hexdigest()
                if contents:
                    rows += zip([doc_id] * len(parts), [sha] * len(parts), range(len(parts)), digests, parts)
                else:
                    rows.append((doc_id, sha, len(text), b"".join(digests)))
            if rows:
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    key = [("doc_id", pa.int64()), ("text_sha256", pa.string())]
    more = (
        [("position", pa.int32()), ("digest", pa.binary()), ("content", pa.binary())]
        if contents
        else [("n_bytes", pa.int64()), ("recipe", pa.binary())]
    )
    names, types = zip(*key, *more)
    return recipes


_DOC = "doc_id long, text_sha256 string, n_bytes long, recipe binary"
_CHUNK = "doc_id long, text_sha256 string, position int, digest binary, content binary"


def _unlike_chunks(chunks: DataFrame) -> DataFrame:
    """Digests that stand for more than one content."""
    return (
        chunks.groupBy("digest")
        .agg(F.min("content").alias("first"), F.max("content").alias("last"))
        .where("first <> last")
        .select("digest")
    )


def exact_groups(
    docs: DataFrame, cut_bits: int = CUT_BITS, digest_bytes: int = DIGEST_BYTES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if all their bytes are; null counts as empty. keep_id is
    the largest doc_id of the group and kept marks its row. Among repeated
    rows of that doc_id, all are marked. A null doc_id is never kept unless
    the whole group has none; then keep_id is null. Other columns of ``docs``
    are left aside. An empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    recipes = written(
        docs.mapInArrow(_recipes(cut_bits, digest_bytes, False), _DOC), "recipes"
    )
    chunks = docs.mapInArrow(_recipes(cut_bits, digest_bytes, True), _CHUNK)
    unlike = written(_unlike_chunks(chunks.select("digest", "content")), "unlike")
    recipes = recipes.withColumn("variants", F.lit(None).cast("array<int>"))
    if not unlike.isEmpty():
        # Digests that do not identify a content: number their contents, and
        # compare these numbers as well.
        doubtful = written(chunks.join(unlike, "digest"), "doubtful")
        numbered = doubtful.select("digest", "content").distinct()
        number = F.row_number().over(Window.partitionBy("digest").orderBy("content"))
        numbered = numbered.withColumn("variant", number)
        variants = (
            doubtful.join(numbered, ["digest", "content"])
            .groupBy("doc_id", "text_sha256")
            .agg(F.array_sort(F.collect_set(F.struct("position", "variant"))).alias("found"))
            .select("doc_id", "text_sha256", F.col("found.variant").alias("variants"))
            .toDF("other_id", "other_sha", "found")
        )
        same = recipes.doc_id.eqNullSafe(variants.other_id) & (
            recipes.text_sha256 == variants.other_sha
        )
        recipes = (
            recipes.drop("variants")
            .join(variants, same, "left")
            .withColumnRenamed("found", "variants")
            .drop("other_id", "other_sha")
        )
    # Equal recipes of chunks of unequal length cannot be: a digest has one content.
    whole = recipes.withColumn("variants", F.coalesce("variants", F.array().cast("array<int>")))
    groups = whole.groupBy("n_bytes", "recipe", "variants").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return whole.join(groups, ["n_bytes", "recipe", "variants"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""
