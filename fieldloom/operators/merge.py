"""XML values over model values, field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.values import present_names

FILENAME_FIELDS = ("invoice_date", "seller", "product_summary", "gross_total", "currency")


def fields_used(value) -> Column:
    """Names of the filename fields that hold a value; ``value`` maps a name to a column."""
    return present_names([(f, value(f).isNotNull()) for f in FILENAME_FIELDS])


def supplies_filename(value) -> Column:
    return reduce(lambda a, b: a & b, [value(f).isNotNull() for f in FILENAME_FIELDS])


def concat_warnings(*lists: Column) -> Column:
    """Warnings in source order, duplicates kept, null lists skipped."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(w, empty) for w in lists])


def merged_columns(has_xml: Column, xml, model) -> dict[str, Column]:
    """The merged fields of one row; ``xml`` and ``model`` map names to columns.

    A valid XML value wins, the model fills what is empty. With XML present
    the evidence is the XML's alone.
    """
    columns = {f: F.coalesce(xml(f), model(f)) for f in FILENAME_FIELDS}
    columns["language"] = F.coalesce(model("language"), F.lit("unknown"))
    columns["evidence"] = F.when(has_xml, xml("evidence")).otherwise(model("evidence"))
    columns["warnings"] = concat_warnings(xml("warnings"), model("warnings"))
    return columns


def merge_sources(xml: DataFrame, model: DataFrame) -> DataFrame:
    """Full outer merge of two extraction tables by doc_id."""
    left = xml.select("doc_id", F.struct(*[c for c in xml.columns if c != "doc_id"]).alias("_x"))
    right = model.select("doc_id", F.struct(*[c for c in model.columns if c != "doc_id"]).alias("_m"))
    joined = left.join(right, "doc_id", "full")
    merged = merged_columns(
        F.col("_x").isNotNull(), lambda f: F.col(f"_x.{f}"), lambda f: F.col(f"_m.{f}")
    )
    return joined.select("doc_id", *[c.alias(n) for n, c in merged.items()])


def extraction_source(n_used: Column, complete: Column) -> Column:
    return (
        F.when(complete, F.lit("xml"))
        .when(n_used > 0, F.lit("xml_and_model"))
        .otherwise(F.lit("model"))
    )
