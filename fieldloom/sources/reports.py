"""Evaluation results on disk: versions of a report, and resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.operators.evaluation import upsert_reports


def unfinished(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows whose (model, document) is not among the finished ones."""
    return rows.join(finished, ["model_id", "doc_id"], "left_anti")


def write_report(spark: SparkSession, fresh: DataFrame, previous: str | None, target: str) -> None:
    """Writes a new report version; the previous one is only read."""
    merged = fresh if previous is None else upsert_reports(spark.read.parquet(previous), fresh)
    merged.write.mode("errorifexists").parquet(target)


def append_results(rows: DataFrame, path: str) -> None:
    """Appends finished rows, one folder per model, so a rerun can skip them."""
    rows.write.mode("append").partitionBy("model_id").parquet(path)


def results_sink(path: str):
    """A ``foreachBatch`` writer that may see a batch twice and keeps it once.

    Each batch owns one folder named by its id, and writing it again replaces
    that folder only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
