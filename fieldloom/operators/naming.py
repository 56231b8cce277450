"""Proposed file names: ``date_seller_product_amount-CUR`` plus extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import MISSING_SEGMENT, filename_segment
from fieldloom.functions.values import (
    MISSING_CURRENCY,
    MISSING_DATE,
    date_or_placeholder,
    present_names,
    rounded_amount,
)

STEM_LIMIT = 150


def _prefer_short(short: str, full: str, columns: list[str]) -> Column:
    if short not in columns:
        return F.col(full)
    return F.coalesce(F.nullif(F.col(short), F.lit("")), F.col(full))


def _size(column: str, columns: list[str]) -> Column:
    return F.coalesce(F.size(F.col(column)), F.lit(0)) if column in columns else F.lit(0)


def propose_filenames(extractions: DataFrame, extension: Column | str = ".pdf") -> DataFrame:
    """Adds proposed_filename, missing_fields, naming_warnings, requires_review.

    Narrow: one pass over the rows, no shuffle. The amount and currency are
    kept whole; only the date/seller/product prefix is cut to the budget.
    """
    columns = extractions.columns
    extension = F.lit(extension) if isinstance(extension, str) else extension
    parts = extractions.withColumns(
        {
            "_seller": filename_segment(_prefer_short("seller_short", "seller", columns)),
            "_product": filename_segment(
                _prefer_short("product_summary_short", "product_summary", columns)
            ),
            "_amount": rounded_amount(F.col("gross_total")),
        }
    )
    unusable = {c: F.coalesce(F.col(c), F.lit("")) == "" for c in ("_seller", "_product")}
    seller = F.when(unusable["_seller"], F.lit(MISSING_SEGMENT)).otherwise(F.col("_seller"))
    product = F.when(unusable["_product"], F.lit(MISSING_SEGMENT)).otherwise(F.col("_product"))
    staged = parts.withColumns(
        {
            "_suffix": F.concat(
                F.lit("_"),
                F.coalesce(F.col("_amount"), F.lit("0")),
                F.lit("-"),
                F.coalesce(F.col("currency"), F.lit(MISSING_CURRENCY)),
            ),
            "_prefix": F.concat_ws("_", date_or_placeholder(F.col("invoice_date")), seller, product),
            "_seller_end": F.lit(len(MISSING_DATE) + 1) + F.length(seller),
        }
    )
    budget = F.greatest(F.lit(0), F.lit(STEM_LIMIT) - F.length("_suffix"))
    cut = F.length("_prefix") > budget
    shortened = F.regexp_replace(F.left(F.col("_prefix"), budget), "[_-]+$", "")
    cut_fields = (
        F.when(budget >= F.col("_seller_end"), F.lit("product"))
        .when(budget >= len(MISSING_DATE), F.lit("seller/product"))
        .otherwise(F.lit("date/seller/product"))
    )
    cut_warning = F.concat(
        cut_fields, F.lit(f" truncated to fit the {STEM_LIMIT}-character filename limit")
    )
    missing = present_names(
        [
            ("date", F.col("invoice_date").isNull()),
            ("seller", unusable["_seller"]),
            ("product", unusable["_product"]),
            ("amount", F.col("gross_total").isNull()),
            ("currency", F.col("currency").isNull()),
        ]
    )
    named = staged.withColumns(
        {
            "proposed_filename": F.concat(
                F.when(cut, shortened).otherwise(F.col("_prefix")), F.col("_suffix"), extension
            ),
            "missing_fields": missing,
            "naming_warnings": F.when(cut, F.array(cut_warning)).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    return named.withColumn(
        "requires_review",
        (F.size("missing_fields") > 0)
        | (_size("warnings", columns) > 0)
        | (F.size("naming_warnings") > 0),
    ).drop("_seller", "_product", "_amount", "_suffix", "_prefix", "_seller_end")
