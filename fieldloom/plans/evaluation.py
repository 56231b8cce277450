"""Evaluation of scorers over a labelled document set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.evaluation import (
    FAILURE_MARKER,
    SCORED_FIELDS,
    model_report,
    score_predictions,
)
from fieldloom.plans.analysis import analyse


def mark_outcomes(runs: DataFrame) -> DataFrame:
    """Sets failed and timing_complete from ``crashed`` and the warnings."""
    crashed = F.coalesce(F.col("crashed"), F.lit(False))
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in runs.columns else F.lit(False)
    if "warnings" in runs.columns:
        failed = failed | F.coalesce(
            F.exists("warnings", lambda w: F.contains(w, F.lit(FAILURE_MARKER))), F.lit(False)
        )
    complete = F.col("timing_complete") if "timing_complete" in runs.columns else F.lit(True)
    return runs.withColumns(
        {"crashed": crashed, "failed": failed | crashed, "timing_complete": complete & ~crashed}
    )


def evaluate_models(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs and long labels to one report row per model.

    Crashed runs stay in the failure rate and leave the latency averages.
    """
    return model_report(score_predictions(mark_outcomes(runs), labels))


def mode_runs(documents: DataFrame, attachments: DataFrame, calls: DataFrame, **repairs) -> DataFrame:
    """Runs of both evaluation modes over the same documents and calls.

    ``text_only`` leaves the embedded XML out, so every field is the scorer's;
    ``xml_first`` is the whole routing. Documents still awaiting an answer are
    left out of both. The mode stands in ``model_id``.
    """
    modes = {"text_only": attachments.limit(0), "xml_first": attachments}
    runs = None
    for mode, held in modes.items():
        analysed = analyse(documents, held, calls, **repairs).filter(F.col("state") != "awaiting")
        run = analysed.select(
            F.lit(mode).alias("model_id"),
            "doc_id",
            *SCORED_FIELDS,
            "warnings",
            (F.col("state") == "failed").alias("crashed"),
            F.lit(False).alias("timing_complete"),
            F.lit(None).cast("double").alias("total_ms"),
            F.lit(None).cast("double").alias("inference_ms"),
        )
        runs = run if runs is None else runs.unionByName(run)
    return runs


def evaluate_modes(
    documents: DataFrame, attachments: DataFrame, calls: DataFrame, labels: DataFrame, **repairs
) -> DataFrame:
    """One report row per evaluation mode."""
    return evaluate_models(mode_runs(documents, attachments, calls, **repairs), labels)
