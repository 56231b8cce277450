"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies.
Whole copies are given; the fractions are rounded in pairs: mass moves between
two documents, weighted by their words, until one fraction is 0 or 1. A pair
keeps its expected words and, on average over the draw, each fraction. Buckets
of a source are rounded apart; the one fraction each leaves goes up a tree of
buckets until one is left per source. So the words taken of a source differ
from its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import row_hash, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17
#: Documents rounded in one group, and groups whose fractions meet in the next.
BUCKET = 4096
FAN_IN = 1024
#: Copies of a row that are listed at once.
LISTED = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_no, n_docs, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` of all words. No target exceeds ``most`` times its source; what is
    cut off goes to the others by weight. One row per source is ordered in one
    task, never one row per document.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("fill", "source_no")
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    # Filling all sources to one level per weight, a source is full at ``fill``.
    # The level holds where the sources that are not full yet can take the rest.
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("source_no", F.row_number().over(by_name))
        .withColumn(
            "weight",
            F.element_at(
                F.array(*(F.lit(float(w)) for w in weights)),
                (F.col("source_no") - 1) % len(weights) + 1,
            ),
        )
        .withColumn("most", F.col("source_size") * F.lit(float(most)))
        .withColumn("fill", F.col("most") / F.col("weight"))
        .withColumn("level", (total - full) / open_weight)
        .withColumn("holds", F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level")))
        .withColumn("level", F.min("holds").over(everything)["level"])
        .withColumn(
            "target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
        )
        .select("source", "source_no", "n_docs", "source_size", "target")
    )


def round_pairs(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The fractions after pairwise rounding: all 0 or 1 but one at most."""
    part = part.astype(float).copy()
    draws = rng.random(len(part))
    held = -1
    for j in range(len(part)):
        if not 0.0 < part[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min(size[i] * (1.0 - part[i]), size[j] * part[j])
        down = min(size[i] * part[i], size[j] * (1.0 - part[j]))
        if draws[j] * (up + down) < down:
            moved, full, empty = up, size[i] * (1.0 - part[i]) <= size[j] * part[j], None
            i_done, j_done = full, size[j] * part[j] <= size[i] * (1.0 - part[i])
            i_to, j_to = 1.0, 0.0
        else:
            moved = -down
            i_done = size[i] * part[i] <= size[j] * (1.0 - part[j])
            j_done = size[j] * (1.0 - part[j]) <= size[i] * part[i]
            i_to, j_to = 0.0, 1.0
        part[i] = i_to if i_done else part[i] + moved / size[i]
        part[j] = j_to if j_done else part[j] - moved / size[j]
        held = -1
        for k in (i, j):
            if 0.0 < part[k] < 1.0:
                held = k
    return part


def _round_bucket(level: int, last: bool, seed: int):
    def round_bucket(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(
            [c for c in ("draw", "doc_id", "tie", "size", "row_key") if c in rows], na_position="last"
        )
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        part = round_pairs(rows["size"].to_numpy(float), rows["part"].to_numpy(), rng)
        if last:  # one fraction is left of the source
            draw = rng.random()
            part = np.where((part > 0) & (part < 1), (draw < part).astype(float), part)
        return rows.assign(part=part)

    return round_bucket


def copies(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: int = SEED,
    bucket: int = BUCKET,
    fan_in: int = FAN_IN,
    row_key: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): how often the mix takes it.

    Columns doc_id, tie (a hash of the text, to tell rows of one doc_id apart), row_key (if given),
    source, size (words; 0 for null), source_size, target, copies (0 to
    ``most``) and taken = copies * size. Rows without words are taken as often
    as the whole part of their source's rate says; they add no words. A null
    source is a source of its own. The draw depends on ``seed`` and the rows
    alone, not on their partitions, so reruns agree; of rows alike in doc_id,
    text and size, it is open which one is taken. Other columns of ``docs`` are
    left aside. An empty table gives an empty table.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("tie"),
        *([] if row_key is None else [row_key.alias("row_key")]),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same_source = sizes.source.eqNullSafe(targets.source)
    units = (
        sizes.join(targets.withColumn("rate", rate), same_source)
        .drop(targets.source)
        .withColumn("whole", F.floor("rate").cast("int"))
        .withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(0.0))
        .withColumn("draw", F.xxhash64("doc_id", "tie", "size", F.lit(seed)))
        .withColumn("n_buckets", F.ceil(F.col("n_docs") / F.lit(bucket)))
        .withColumn("bucket", F.pmod(F.xxhash64("draw"), F.col("n_buckets")))
        .drop("rate", "n_docs")
    )
    settled, level = [], 0
    while True:
        top = units.agg(F.max("n_buckets")).first()[0] or 0
        rounded = units.groupBy("source_no", "bucket").applyInPandas(
            _round_bucket(level, top <= 1, seed), units.schema
        )
        rounded = written(rounded, "rounded")
        settled.append(rounded.where("part in (0.0, 1.0)"))
        if top <= 1:
            break
        units = (
            rounded.where("part not in (0.0, 1.0)")
            .withColumn("bucket", F.floor(F.col("bucket") / F.lit(fan_in)))
            .withColumn("n_buckets", F.ceil(F.col("n_buckets") / F.lit(fan_in)))
        )
        level += 1
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.union(more)
    taken = F.col("whole") + F.col("part").cast("int")
    return rows.select(
        "doc_id",
        "tie",
        *([] if row_key is None else ["row_key"]),
        "source",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        taken.alias("copies"),
        (taken * F.col("size")).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``copies`` says, all columns kept.

    Rows that differ in any column have copies of their own. Rows alike in all
    columns cannot be told apart; one stands for them with all their copies.
    """
    key = row_hash(docs)
    taken = (
        copies(docs, **how, row_key=key)
        .groupBy("doc_id", "row_key", "source")
        .agg(F.sum("copies").alias("copies"))
        .where("copies > 0")
        .toDF("id", "hash", "origin", "copies")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("row_key"))
    rows = rows.withColumns({"doc_id": F.col("row.doc_id").cast("long"), "source": F.col("row.source").cast("string")})
    one = rows.dropDuplicates(["doc_id", "row_key", "source"])
    same = one.doc_id.eqNullSafe(taken.id) & (one.row_key == taken.hash) & one.source.eqNullSafe(taken.origin)
    # A row repeated very often makes its copies in lists of bounded length.
    lists = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / LISTED))
    listed = one.join(taken, same).select("row", "copies", F.explode(lists).alias("list"))
    within = F.least(F.col("copies") - F.col("list") * LISTED, F.lit(LISTED).cast("long"))
    return listed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), within))).select("row.*")
