"""Recognised words and boxes back to page text, in reading order.

Both operators build one string per page, so a page is the unit of work: the
words are shuffled once, by page, and never gathered at a wider level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import ustrip

PAGE = ("doc_id", "page_number")

# Fixed value: vertical centres this close, relative to height, share a row.
ROW_TOLERANCE = 0.5


def words_to_pages(words: DataFrame) -> DataFrame:
    """Words to lines by (block, par, line) in order of first appearance."""
    spoken = (
        words.withColumn("word", ustrip(F.col("word")))
        .filter(F.col("word") != "")
        .repartition(*PAGE)
    )
    scored = F.when(F.col("conf") >= 0, F.col("conf"))
    lines = spoken.groupBy(*PAGE, "block", "par", "line").agg(
        F.min("idx").alias("first_idx"),
        F.array_sort(F.collect_list(F.struct("idx", "word"))).alias("words"),
        F.sum(scored).alias("conf_sum"),
        F.count(scored).alias("conf_n"),
    )
    text = F.array_join(F.col("words.word"), " ")
    pages = (
        lines.select(*PAGE, "conf_sum", "conf_n", F.struct("first_idx", text.alias("text")).alias("line"))
        .groupBy(*PAGE)
        .agg(
            F.array_sort(F.collect_list("line")).alias("lines"),
            F.sum("conf_sum").alias("conf_sum"),
            F.sum("conf_n").alias("conf_n"),
        )
    )
    mean = F.when(F.col("conf_n") > 0, F.col("conf_sum") / F.col("conf_n") / 100)
    return pages.select(
        *PAGE, F.array_join(F.col("lines.text"), "\n").alias("text"), mean.alias("confidence")
    )


def boxes_to_pages(boxes: DataFrame) -> DataFrame:
    """Boxes to visual rows, top to bottom, each row left to right.

    Which row a box joins depends on the first box of the row before it, so
    the boxes of a page are folded in order of vertical centre.
    """
    centre = F.col("y") + F.col("h") / 2
    box = F.struct(
        (-centre).alias("down"),
        F.col("idx").alias("idx"),
        F.col("h").alias("h"),
        F.col("x").alias("x"),
        F.col("text").alias("text"),
    )
    pages = boxes.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(box)).alias("boxes"), F.avg("conf").alias("confidence")
    )
    start = F.expr(
        "named_struct('at', 0, 'down', cast(null as double), 'h', cast(null as double), "
        "'starts', cast(array() as array<int>))"
    )

    def place(state, b):
        joins = F.coalesce(
            F.abs(b["down"] - state["down"])
            <= F.lit(ROW_TOLERANCE) * F.greatest(b["h"], state["h"]),
            F.lit(False),
        )
        return F.struct(
            (state["at"] + 1).alias("at"),
            F.when(joins, state["down"]).otherwise(b["down"]).alias("down"),
            F.when(joins, state["h"]).otherwise(b["h"]).alias("h"),
            F.when(joins, state["starts"])
            .otherwise(F.concat(state["starts"], F.array(state["at"])))
            .alias("starts"),
        )

    # The state keeps where rows start, not the boxes, which would be copied each time.
    starts = F.aggregate(F.col("boxes"), start, place, lambda s: s["starts"])
    ruled = pages.select(*PAGE, "confidence", "boxes", starts.alias("starts"))
    boxes_, starts = F.col("boxes"), F.col("starts")

    def row_text(first, k):
        after = F.coalesce(F.get(starts, k + 1), F.size(boxes_))
        cells = F.transform(
            F.slice(boxes_, first + 1, after - first),
            lambda b, i: F.struct(b["x"].alias("x"), i.alias("pos"), b["text"].alias("text")),
        )
        return F.array_join(F.transform(F.array_sort(cells), lambda c: c["text"]), " ")

    text = F.array_join(F.transform(starts, row_text), "\n")
    return ruled.select(*PAGE, text.alias("text"), "confidence")
