"""Rename history and rename plans as append-only tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HISTORY_SCHEMA = (
    "batch_id string, seq long, applied_at timestamp, source_path string, "
    "destination_path string, identity string, event string"
)


def append_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """History plus new events; earlier rows never change."""
    return history.unionByName(events)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """A missing store is empty; anything else that cannot be read is an error."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).option("mergeSchema", "false").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], HISTORY_SCHEMA)
        raise


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """The same store kept as JSON lines; a malformed line fails the read."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], HISTORY_SCHEMA)
        raise


def append_history(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_plan(plan: DataFrame, path: str) -> None:
    """Writes a rename plan; no file it names is touched."""
    plan.write.mode("errorifexists").parquet(path)
