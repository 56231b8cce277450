"""Page routing and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import ustrip, visible_length

# Sparse-page threshold and page ceiling.
MIN_VISIBLE_CHARS = 20
MAX_PAGES = 200


def is_sparse(text_layer: Column) -> Column:
    """A page whose text layer has too few visible characters needs OCR."""
    return visible_length(F.coalesce(text_layer, F.lit(""))) < MIN_VISIBLE_CHARS


def route_pages(pages: DataFrame) -> DataFrame:
    """Adds needs_ocr and the page text: the stripped layer, or the OCR text."""
    needs_ocr = is_sparse(F.col("text_layer"))
    routed = pages.withColumn("needs_ocr", needs_ocr)
    confidence = F.col("ocr_confidence") if "ocr_confidence" in pages.columns else F.lit(None)
    return routed.withColumns(
        {
            "text": F.when(F.col("needs_ocr"), F.coalesce("ocr_text", F.lit(""))).otherwise(
                ustrip(F.col("text_layer"))
            ),
            "ocr_confidence": F.when(F.col("needs_ocr"), confidence.cast("double")),
        }
    ).select("doc_id", "page_number", "text", "needs_ocr", "ocr_confidence")


def pages_block(pages: Column) -> Column:
    """The text of all pages, each under a numbered marker."""
    return F.array_join(
        F.transform(
            pages,
            lambda p: F.concat(
                F.lit("--- Page "), p["page_number"].cast("string"), F.lit(" ---\n"), p["text"]
            ),
        ),
        "\n\n",
    )


def assemble_pages(routed: DataFrame) -> DataFrame:
    """One row per document with all its pages in order and the OCR counters.

    Page numbers may have gaps. Documents are refused for their page count
    before this step (``sources.documents``), and never here.
    """
    page = F.struct("page_number", "text", "needs_ocr", "ocr_confidence")
    return routed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_total"),
        F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page_number")))).alias("pages_ocr"),
        F.array_sort(F.collect_list(page)).alias("pages"),
    )


def refused_documents(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """(doc_id, pages_total, reason) of documents with more than ``most`` pages."""
    counted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_total"))
    reason = F.concat(F.col("pages_total").cast("string"), F.lit(f" pages, at most {most} are taken"))
    return counted.where(F.col("pages_total") > most).withColumn("reason", reason)
