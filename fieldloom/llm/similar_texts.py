"""Links between texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of 64 bits tell texts of similarity 0.8 from unrelated ones, but
pigeonhole blocks that find them at ten differing bits would be four bits wide.
So MinHash bands retrieve the candidates. Within a band's key, texts are
compared by sketches, one byte for each hash function, and only the strongest
links that connect a class are kept; each of these is then checked on the
shingles of both whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, keep_only, slices, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares one of the bands with probability 0.998.
BANDS, BAND_ROWS = 21, 6
#: Shares of equal sketch bytes at which pairs are linked, the strongest first.
#: At the last one a pair of similarity 0.8 is left out with probability 0.015.
LEVELS = (0.95, 0.85, 0.72)
#: Members of one key that meet in one task; larger keys are dealt as tile pairs.
TILE = 1024
_HASHES = BANDS * BAND_ROWS
_SLAB = 1 << 12
_SEEDS = np.random.default_rng(5).integers(1 << 62, size=_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the shingles of one UTF-8 text, A-Z in lower case; a shorter text is one."""
    parts = text.lower().split()
    n = len(parts)
    if n == 0:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
    spans = zip(starts, ends[words - 1 :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, n - words + 1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of ``hashes`` (one at least) under each hash function."""
    least = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _SLAB):
        np.minimum(least, (hashes[at : at + _SLAB, None] * _SEEDS).min(axis=0), out=least)
    return least


def sketch(text: bytes) -> tuple[bytes | None, list[int] | None]:
    """One byte for each hash function, and the key of each band; none for a text without words."""
    hashes = shingles(text)
    if not len(hashes):
        return None, None
    least = minima(hashes)
    own = ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()
    rows = least.reshape(BANDS, BAND_ROWS)
    return own, [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def sketches(texts: DataFrame) -> DataFrame:
    """(text_key, sketch, bands) of the distinct texts of ``texts`` (text_key, text)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text"):
            made = [sketch(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_key"),
                    pa.array([s for s, _ in made], pa.binary()),
                    pa.array([b for _, b in made], pa.list_(pa.int64())),
                ],
                ["text_key", "sketch", "bands"],
            )

    rows = texts.select("text_key", "text").mapInArrow(
        sketched, "text_key long, sketch binary, bands array<long>"
    )
    return rows.where("sketch is not null").dropDuplicates(["text_key"])


def strongest(group: np.ndarray, sketched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect the classes of each group at the last of LEVELS.

    ``group`` is sorted. Pairs are compared at growing offsets, level by level,
    and those that already share a class are left out, so that any two texts
    are connected by links about as strong as their own.
    """
    label, found = np.arange(len(group)), []
    for level in LEVELS:
        least, step, rows = level * _HASHES, 1, np.arange(len(group))
        while True:
            rows = rows[rows + step < len(group)]
            rows = rows[group[rows] == group[rows + step]]
            if not len(rows):
                break
            apart = rows[label[rows] != label[rows + step]]
            for at in range(0, len(apart), _SLAB):
                part = apart[at : at + _SLAB]
                near = part[(sketched[part] == sketched[part + step]).sum(axis=1) >= least]
                if len(near):
                    found.append(np.stack([near, near + step]))
                    _settle(label, near, near + step)
            step += 1
    a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return a, b


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i]; equal labels are one class."""
    while True:
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


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over rows sorted by (band, value, pair): the strongest links."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _ in held])
        sketched = np.concatenate([s for _, s in held])
        held.clear()
        group = np.concatenate(([0], np.cumsum((keys[1:, :3] != keys[:-1, :3]).any(axis=1))))
        a, b = strongest(group, sketched)
        return pa.RecordBatch.from_arrays([pa.array(keys[a, 3]), pa.array(keys[b, 3])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]], axis=1)
        sketched = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, _HASHES)
        # Whole groups only: what may go on in the next batch is held back.
        other = np.flatnonzero((keys[:, :3] != keys[-1, :3]).any(axis=1))
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            held.append((keys[:cut], sketched[:cut]))
            yield settle()
        elif held and (held[-1][0][-1, :3] != keys[0, :3]).any():
            yield settle()
        held.append((keys[cut:], sketched[cut:]))
    if held:
        yield settle()


def candidates(made: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b: text keys, a < b) between the sketches of ``made`` that share a band, unchecked.

    Within a key the links of a class connect it, and are few. A key with over
    ``tile`` members is dealt to tiles, each pair of tiles to a task of its own.
    """
    keyed = made.select("text_key", F.posexplode("bands").alias("band", "value"))
    sizes = keyed.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keyed.join(sizes, ["band", "value"]).join(made.select("text_key", "sketch"), "text_key")
    tiles = F.ceil(F.col("size") / F.lit(tile)).cast("long")
    own = F.pmod(F.xxhash64("text_key"), tiles)
    pair = F.transform(
        F.sequence(F.lit(0).cast("long"), tiles - 1),
        lambda j: F.least(j, own) * F.lit(1 << 31).cast("long") + F.greatest(j, own),
    )
    dealt = shared.select(
        F.col("band").cast("long").alias("band"), "value", F.explode(pair).alias("pair"), "text_key", "sketch"
    )
    # Without a count of partitions the engine would be free to split a key.
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "band", "value", "pair").sortWithinPartitions("band", "value", "pair")
    links = dealt.mapInArrow(_pairs, "a long, b long")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(similarity: float):
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for whole in batches:
            for batch in slices([whole], "text_b"):
                a = batch.column("a").to_pylist()
                texts = zip(as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b")))
                keep = []
                for key, (one, two) in zip(a, texts):
                    if key != last[0]:
                        last = (key, shingles(one))
                    own, other = last[1], shingles(two)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(both >= similarity * (len(own) + len(other) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return checked


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Links (a, b: text keys) that connect texts of ``texts`` (text_key, text) alike by ``similarity`` or more.

    Equal text keys are one text. Texts without words have no links. Every link
    listed is checked on all shingles of both texts; of the close pairs, those
    are left out that links connect already, and some by chance: see BANDS and
    LEVELS. An empty table gives an empty table.
    """
    made = written(sketches(texts), "sketches")
    links = written(candidates(made, tile), "candidates")
    nodes = links.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    wanted = written(
        texts.select("text_key", "text").join(nodes, "text_key", "left_semi").dropDuplicates(["text_key"]),
        "candidate-texts",
    )
    both = links.join(wanted.toDF("a", "text_a"), "a").join(wanted.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_similar(similarity), "a long, b long")
