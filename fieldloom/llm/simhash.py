"""Near duplicates by SimHash: pigeonhole blocks, then Hamming distance.

Fingerprints that differ in at most d of 64 bits agree in at least b - d of b
blocks. Every choice of b - d blocks is a join key, so each close pair meets
under some key. The number of blocks follows the number of fingerprints, so
that a key holds few of them; all choices find the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, keep_only, row_hash, slices, written
from fieldloom.llm.components import components
from fieldloom.llm.similar_texts import similar_links

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: Members of one key that meet in one task; larger keys are dealt as tile pairs.
TILE = 4096
_SLAB = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> bytes:
    """8 bytes, most significant first, of one UTF-8 text."""
    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(parts)
    if n == 0:
        return bytes(8)
    joined, digest = b" ".join(parts), xxhash.xxh64_digest
    if n <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
    ends = ends[words - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(ends), _SLAB):
        pairs = zip(starts[at : at + _SLAB], ends[at : at + _SLAB])
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > len(ends)).tobytes()


def _fingerprints(words: int, *keys: str):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text"):
            prints = [fingerprint(t, words) for t in as_bytes(batch.column("text"))]
            values = np.frombuffer(b"".join(prints), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", *keys)), pa.array(values)], ["doc_id", *keys, "bits"]
            )

    return fingerprints


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, bits): the fingerprint of each row of ``docs`` as a long."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_fingerprints(words), "doc_id long, bits long")


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of the block choices for n fingerprints, as signed longs."""
    blocks = distance + 2
    while True:
        width = 64 // blocks
        kept = blocks - distance
        if n <= 32 << (kept * width) or blocks >= 4 * distance:
            break
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, kept)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; labels point at smaller rows of the class."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            return
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        a, b = a[open_], b[open_]


def close_rows(group: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the first rows of their classes, over close pairs within equal groups.

    ``group`` is sorted. Rows are compared at growing offsets, all groups at
    once, and pairs that already share a class are left out.
    """
    label, rows, step = np.arange(len(bits)), np.arange(len(bits)), 1
    while True:
        rows = rows[rows + step < len(bits)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        apart = rows[label[rows] != label[rows + step]]
        near = apart[np.bitwise_count(bits[apart] ^ bits[apart + step]) <= distance]
        _settle(label, near, near + step)
        step += 1
    linked = np.flatnonzero(label != np.arange(len(bits)))
    return linked, label[linked]


def _links(distance: int):
    """mapInArrow function over rows sorted by (choice, part, tile): links of each class."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(table: np.ndarray) -> pa.RecordBatch:
            fresh = (table[1:, :3] != table[:-1, :3]).any(axis=1)
            group = np.concatenate(([0], np.cumsum(fresh)))
            bits = table[:, 3]
            high, low = close_rows(group, bits, distance)
            return pa.RecordBatch.from_arrays(
                [pa.array(bits[high]), pa.array(bits[low])], ["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            # Whole groups only: what may go on in the next batch is held back.
            other = np.flatnonzero((table[:, :3] != table[-1, :3]).any(axis=1))
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield settle(np.concatenate([*held, table[:cut]]))
                held = []
            elif held and (held[-1][-1, :3] != table[0, :3]).any():
                yield settle(np.concatenate(held))
                held = []
            held.append(table[cut:])
        if held:
            yield settle(np.concatenate(held))

    return links


def close_links(prints: DataFrame, distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (bits) at ``distance`` or less.

    Not every close pair is listed: within a key, the links of a class form a
    tree. A key with over ``tile`` members is dealt to tiles, and each pair of
    tiles is compared in a task of its own.
    """
    masks = block_masks(prints.count(), distance)
    choices = F.array(
        *(
            F.struct(F.lit(i).cast("long").alias("choice"), F.col("bits").bitwiseAND(F.lit(m)).alias("part"))
            for i, m in enumerate(masks)
        )
    )
    keyed = prints.select("bits", F.explode(choices).alias("c")).select("c.*", "bits")
    sizes = keyed.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    keyed = keyed.join(sizes, ["choice", "part"])
    tiles = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("bits"), tiles.cast("long"))
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), tiles.cast("long") - 1),
        lambda j: F.least(j, own) * F.lit(1 << 31).cast("long") + F.greatest(j, own),
    )
    dealt = keyed.select("choice", "part", F.explode(pair).alias("pair"), "bits")
    # Without a count of partitions the engine would be free to split a key.
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "choice", "part", "pair").sortWithinPartitions(
        "choice", "part", "pair"
    )
    return dealt.mapInArrow(_links(distance), "a long, b long")


def _rooted(prints: DataFrame, distance: int, tile: int, more: DataFrame | None = None) -> DataFrame:
    """(bits, least, root) of the distinct fingerprints of ``prints`` (doc_id, bits): root names the component.

    ``more`` holds further links (a, b) between fingerprints.
    """
    # Equal fingerprints are one node, so a large group of copies is one row from here on.
    distinct = written(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    links = close_links(distinct.select("bits"), distance, tile)
    roots = components(links if more is None else links.union(more))
    return distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left").withColumn(
        "root", F.coalesce("root", "bits")
    )


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, tile: int = TILE
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    component_id is the smallest doc_id that links reach (fingerprints that
    differ in at most ``distance`` bits, equal ones included). Null and empty
    texts have fingerprint zero and link like any other; a null doc_id takes
    part, but names no component unless no other id is there. Other columns of
    ``docs`` are left aside. An empty table gives an empty table.
    """
    prints = written(fingerprints(docs, words), "prints")
    rooted = _rooted(prints, distance, tile)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return prints.join(named, "bits").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


#: What tells rows apart: a hash of the text and one of the whole row.
_ROW_KEY = ["text_key", "row_key"]


def keep_first(
    docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, similarity: float | None = None
) -> DataFrame:
    """``docs`` without near duplicates: of each group one row, the row of its smallest doc_id.

    With a ``similarity``, texts whose five-word shingles are alike by that
    share or more link as close fingerprints do (``similar_texts``).
    Groups are told apart by their texts, so a doc_id that stands in two groups
    may stay in both. If that doc_id stands on several rows of the group, the
    row of the smallest text hash stays, then of the smallest hash of the whole
    row; null doc_ids come last. All columns are kept, whatever their names.
    """
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.xxhash64(F.col("text"), F.lit(1)).alias("text_key"),
        row_hash(docs).alias("row_key"),
    )
    rows = keyed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", *_ROW_KEY)
    prints = written(
        rows.mapInArrow(_fingerprints(words, *_ROW_KEY), "doc_id long, text_key long, row_key long, bits long"),
        "prints",
    )
    more = None
    if similarity is not None:
        bits = prints.select("text_key", "bits").distinct()
        links = similar_links(rows, similarity)
        links = links.join(bits.toDF("a", "bits_a"), "a").join(bits.toDF("b", "bits_b"), "b")
        more = links.select(F.col("bits_a").alias("a"), F.col("bits_b").alias("b"))
    rooted = _rooted(prints.select("doc_id", "bits"), distance, TILE, more)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *_ROW_KEY)
    first = (
        prints.join(rooted.select("bits", "root"), "bits")
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(*(F.col(f"first.{c}").alias(c) for c in _ROW_KEY))
        .distinct()
    )
    return keyed.join(first, _ROW_KEY, "left_semi").dropDuplicates(_ROW_KEY).select("row.*")
