"""Document folders: listing, format sniffing, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import base_name, parent_dir
from fieldloom.functions.values import document_format
from fieldloom.operators.pages import MAX_PAGES

# Upload bound in bytes and pixel bound per side.
MAX_DOCUMENT_BYTES = 50 * 1024 * 1024
MAX_SIDE_PIXELS = 8000


def is_supported_path(path: Column) -> Column:
    return path.rlike("(?i)\\.(pdf|jpe?g)\\z")


def _described(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.filter(is_supported_path(path)).select(
        path.alias("source_path"),
        parent_dir(path).alias("dir"),
        base_name(path).alias("file_name"),
        F.col("length").alias("byte_len"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    )


def scan_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Supported files under the given folders; a path given twice counts twice.

    Columns are read on demand: a plan that uses names and sizes only never
    opens the files.
    """
    scans = [
        _described(
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        )
        for path in paths
    ]
    result = scans[0]
    for scan in scans[1:]:
        result = result.unionByName(scan)
    return result


def stream_documents(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same listing as an arrival stream, throttled by file count."""
    files = (
        spark.readStream.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(path)
    )
    return _described(files)


def with_format(documents: DataFrame, content: str = "content") -> DataFrame:
    return documents.withColumn("format", document_format(F.col(content)))


def reject_reason(byte_len: Column, fmt: Column, pages: Column, width: Column, height: Column) -> Column:
    """The first rule a document breaks, or null."""
    pdf, jpeg = fmt == "pdf", fmt == "jpeg"
    # The texts of the messages below are results that must come out the same.
    return (
        F.when(byte_len > MAX_DOCUMENT_BYTES, F.lit(f"upload exceeds the {MAX_DOCUMENT_BYTES}-byte limit"))
        .when(fmt.isNull(), F.lit("upload must be a PDF or JPEG file"))
        .when(pdf & (pages == 0), F.lit("PDF has no pages"))
        .when(pdf & (pages > MAX_PAGES), F.lit(f"PDF has too many pages (> {MAX_PAGES})"))
        .when(
            jpeg & ((width > MAX_SIDE_PIXELS) | (height > MAX_SIDE_PIXELS)),
            F.format_string(
                f"JPEG dimensions (%dx%d) exceed the {MAX_SIDE_PIXELS}px-per-side limit", width, height
            ),
        )
    )


def admit(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined), decided on metadata columns only."""
    judged = documents.withColumn(
        "reject_reason",
        reject_reason(*[F.col(c) for c in ("byte_len", "format", "page_count", "width", "height")]),
    )
    return (
        judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.filter(F.col("reject_reason").isNotNull()),
    )


def observed_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root/<model_id>/`` with size and SHA-256, for the audit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_extract("path", f"{root.rstrip('/')}/([^/]+)/(.*)$", 1)
    return files.select(
        below.alias("model_id"),
        F.regexp_extract("path", f"{root.rstrip('/')}/([^/]+)/(.*)$", 2).alias("path"),
        F.col("length").alias("observed_size"),
        F.sha2("content", 256).alias("observed_digest"),
    )
