"""Progress of a running evaluation, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observe_progress(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Counts rows and failures as they pass; read them when the job is done.

    On a stream the same figures arrive per trigger in the query progress.
    """
    progress = Observation(name)
    counted = rows.observe(
        progress, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("failed")).alias("failed")
    )
    return counted, progress
