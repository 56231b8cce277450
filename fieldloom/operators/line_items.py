"""Dominant product or top-2 product summary per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.stages import settle
from fieldloom.functions.text import FIELD_TEXT_LIMIT

# When one item dominates, and how two are combined.
DOMINANCE_RATIO = 2
COMBINE_SEPARATOR = " + "

# The texts of the messages below are results that must come out the same.
_FALLBACK = "; falling back to AI extraction"
NO_NAME_WARNING = "product_summary: multiple XML line items include one with no usable name" + _FALLBACK
NO_AMOUNT_WARNING = (
    "product_summary: multiple XML line items include one with no usable amount" + _FALLBACK
)
TOO_LONG_WARNING = (
    f"product_summary: combined top line items exceed {FIELD_TEXT_LIMIT} characters" + _FALLBACK
)


def summary_from_ranking(
    n_items: Column,
    n_unnamed: Column,
    n_unpriced: Column,
    first: tuple[Column, Column],
    second: tuple[Column, Column],
) -> tuple[Column, Column]:
    """(summary, warning) from counts and the two largest (name, amount) pairs."""
    name1, amount1 = first
    name2, amount2 = second
    both = F.concat(name1, F.lit(COMBINE_SEPARATOR), name2)
    dominant = (amount1 > 0) & (amount1 >= amount2 * DOMINANCE_RATIO)
    oversized = F.length(both) > FIELD_TEXT_LIMIT
    usable = (n_unnamed == 0) & (n_unpriced == 0)
    summary = (
        F.when(n_items == 1, name1)
        .when((n_items > 1) & usable & dominant, name1)
        .when((n_items > 1) & usable & ~oversized, both)
    )
    warning = (
        F.when(n_items <= 1, F.lit(None).cast("string"))
        .when(n_unnamed > 0, F.lit(NO_NAME_WARNING))
        .when(n_unpriced > 0, F.lit(NO_AMOUNT_WARNING))
        .when(~dominant & oversized, F.lit(TOO_LONG_WARNING))
    )
    return summary, warning


def top_items(items: DataFrame, k: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k largest items per document; equal amounts keep document order.

    The rank filter becomes a per-task group limit before the shuffle, so a
    document with very many items sends only k rows per task.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("amount").desc_nulls_last(), F.col("ord"))
    return items.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summarize_products(items: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, ord, name, amount) rows to one product summary per document."""
    counts = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("name").isNull()).alias("n_unnamed"),
        F.count_if(F.col("amount").isNull()).alias("n_unpriced"),
    )
    leaders = (
        top_items(items, 2, keys)
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}")
                for r in (1, 2)
                for c in ("name", "amount")
            ]
        )
    )
    summary, warning = summary_from_ranking(
        F.col("n_items"),
        F.col("n_unnamed"),
        F.col("n_unpriced"),
        (F.col("name1"), F.col("amount1")),
        (F.col("name2"), F.col("amount2")),
    )
    return counts.join(leaders, list(keys), "left").select(
        *keys, "n_items", summary.alias("product_summary"), warning.alias("product_warning")
    )


def rank_array(items: Column) -> Column:
    """ARRAY<STRUCT<ord,name,amount>> to the counts and the two largest items."""
    # Not array_sort, which compares by an interpreted function; no element is null here.
    ranked = F.sort_array(
        F.transform(
            items,
            lambda i: F.struct(
                i["amount"].isNull().alias("unpriced"),
                (-i["amount"]).alias("owed"),
                i["ord"].alias("ord"),
                i["name"].alias("name"),
            ),
        )
    )
    return F.struct(
        F.coalesce(F.size(items), F.lit(0)).alias("n_items"),
        F.size(F.filter(items, lambda i: i["name"].isNull())).alias("n_unnamed"),
        F.size(F.filter(items, lambda i: i["amount"].isNull())).alias("n_unpriced"),
        F.slice(ranked, 1, 2).alias("top"),
    )


def summary_of_ranked(ranked: Column) -> tuple[Column, Column]:
    """The summary rule over the result of ``rank_array``."""
    first, second = F.get(ranked["top"], 0), F.get(ranked["top"], 1)
    return summary_from_ranking(
        ranked["n_items"],
        ranked["n_unnamed"],
        ranked["n_unpriced"],
        (first["name"], -first["owed"]),
        (second["name"], -second["owed"]),
    )


def explode_items(documents: DataFrame, items: str = "items") -> DataFrame:
    """One row per line item of a parsed document, in document order."""
    # A generator's input is also tested for rows; that test must not repeat how the items were made.
    settled = settle(documents.select("doc_id", F.col(items).alias("items")), {"items": F.col("items")})
    return settled.select("doc_id", F.posexplode("items").alias("pos", "item")).select(
        "doc_id",
        (F.col("pos") + 1).cast("bigint").alias("ord"),
        F.col("item.name").alias("name"),
        F.col("item.amount").alias("amount"),
    )
