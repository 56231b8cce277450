"""Ground-truth labels: document to field to value or explicit null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.json_entries import SPLIT_BYTES, json_entries

LABEL_FIELDS = "map<string,string>"
LABEL_TYPE = f"map<string,{LABEL_FIELDS}>"


def explode_labels(files: DataFrame) -> DataFrame:
    """JSON text (column ``value``) to (document, field, expected) rows.

    A row exists exactly where a label exists, so absent and null stay apart.
    Of a key that a file repeats, the last one counts.
    """
    parsed = files.select(
        F.monotonically_increasing_id().alias("_file"),
        F.from_json("value", LABEL_TYPE, {"mode": "FAILFAST"}).alias("labels"),
    )
    listed = parsed.select("_file", F.posexplode(F.map_entries("labels")).alias("_at", "_entry"))
    return _last_fields(
        listed.select("_file", "_at", F.col("_entry.key").alias("document"), F.col("_entry.value").alias("fields"))
    )


def _last_fields(entries: DataFrame) -> DataFrame:
    """(document, field, expected) of entries (_file, _at, document, fields); the last of a file counts."""
    documents = entries.groupBy("_file", "document").agg(F.max_by("fields", "_at").alias("fields"))
    fields = F.map_entries("fields")
    # A document has few fields, so looking for a later one of the same name is cheap.
    last = F.filter(
        fields,
        lambda e, i: ~F.exists(
            F.slice(fields, i + 2, F.size(fields)), lambda later: later["key"] == e["key"]
        ),
    )
    kept = documents.select("document", F.explode(last).alias("_field"))
    return kept.select(
        "document", F.col("_field.key").alias("field"), F.col("_field.value").alias("expected")
    )


def read_labels(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Label files, one JSON object per file, each read by as many tasks as its size asks for.

    A missing path holds no labels; a corrupt file is an error.
    """
    found = json_entries(spark, path, split_bytes)
    # A null entry is a document without labels; a parser of maps would refuse it.
    fields = F.when(F.col("value") != "null", F.from_json("value", LABEL_FIELDS, {"mode": "FAILFAST"}))
    return _last_fields(
        found.select(F.col("path").alias("_file"), F.col("place").alias("_at"), F.col("key").alias("document"), fields.alias("fields"))
    )


def labels_to_json(labels: DataFrame) -> DataFrame:
    """Long labels to label JSON, one object per document.

    Rows that repeat a field are one entry: the last by column ``seq`` where
    there is one, else the largest value.
    """
    last = F.max_by("expected", "seq") if "seq" in labels.columns else F.max("expected")
    single = labels.groupBy("doc_id", "field").agg(last.alias("expected"))
    fields = F.map_from_entries(F.collect_list(F.struct("field", "expected")))
    per_document = single.groupBy("doc_id").agg(fields.alias("fields"))
    nested = F.create_map(F.col("doc_id").cast("string"), F.col("fields"))
    return per_document.select(F.to_json(nested, {"ignoreNullFields": "false"}).alias("value"))
