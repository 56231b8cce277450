"""Connected components of a table of links, by alternating star contraction.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected components
in MapReduce and beyond". Each half step is a partial aggregate (the smallest
neighbour) and a join; no neighbourhood is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "near")
    least = both.groupBy("node").agg(F.min("near").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    return (
        both.where("near > node")
        .join(least, "node")
        .select(F.col("near").alias("high"), F.col("least").alias("low"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where("low > least")
    return (
        moved.select(F.col("low").alias("high"), F.col("least").alias("low"))
        .union(least.select("high", F.col("least").alias("low")))
        .distinct()
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` (a, b: two nodes of one type) to rows (node, root).

    root is the smallest node that links reach; nodes without links to another
    node are not listed. Nulls and links of a node to itself are ignored.
    """
    links = links.toDF("a", "b").where("a <> b")
    links = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    links = written(links.distinct(), "links")
    state = None
    for _ in range(rounds):
        links = written(_small_star(_large_star(links)), "links")
        seen = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if seen == state:
            return links.select(F.col("high").alias("node"), F.col("low").alias("root"))
        state = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
