"""Predictions against labels: scores per row, rates per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import contains_phrase, fold_for_match
from fieldloom.functions.values import same_number

SCORED_FIELDS = ("invoice_date", "seller", "product_summary", "gross_total", "currency")
PHRASE_FIELDS = ("seller", "product_summary")

# Fixed value: the text that marks an extraction no response could be read for.
FAILURE_MARKER = "model output could not be validated"


def field_matches(field: str, extracted: Column, expected: Column) -> Column:
    """One labelled field: numbers as numbers, names as whole phrases, else text."""
    extracted = extracted.cast("string")
    if field == "gross_total":
        equal = same_number(extracted, expected)
    elif field in PHRASE_FIELDS:
        equal = contains_phrase(fold_for_match(extracted), fold_for_match(expected))
    else:
        equal = fold_for_match(extracted) == fold_for_match(expected)
    return F.when(extracted.isNull() | expected.isNull(), extracted.isNull() & expected.isNull()).otherwise(
        equal
    )


def labels_per_document(labels: DataFrame) -> DataFrame:
    """Long labels to one row per document.

    ``label_<field>`` is null where the document has no such label and a
    struct where it has one, so an explicit null label stays visible.
    """
    present = lambda f: F.when(F.col("field") == f, F.struct("expected"))
    return labels.groupBy("doc_id").agg(
        *[F.max(present(f)).alias(f"label_{f}") for f in SCORED_FIELDS],
        F.bool_or(F.col("expected").isNull()).alias("has_null_label"),
    )


def score_predictions(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds match_<field>, hallucinated_fields and the judged/needs flags.

    Labels are folded to one narrow row per document first, so predictions
    are shuffled once and never multiplied by the number of fields. A crashed
    run has produced no trustworthy value, so each of its labels is a miss.
    """
    columns = predictions.columns
    crashed = (
        F.coalesce(F.col("crashed"), F.lit(False)) if "crashed" in columns else F.lit(False)
    )
    joined = predictions.join(labels_per_document(labels), "doc_id", "left")
    value = lambda f: F.col(f) if f in columns else F.lit(None).cast("string")
    label = lambda f: F.col(f"label_{f}")
    matches = {
        f"match_{f}": F.when(label(f).isNull(), None)
        .when(crashed, False)
        .otherwise(field_matches(f, value(f), label(f)["expected"]))
        for f in SCORED_FIELDS
    }
    invented = F.array_compact(
        F.array(
            *[
                F.when(
                    label(f).isNotNull() & label(f)["expected"].isNull() & value(f).isNotNull() & ~crashed,
                    F.lit(f),
                )
                for f in SCORED_FIELDS
            ]
        )
    )
    scored = joined.withColumns({**matches, "hallucinated_fields": invented})
    every = [F.col(f"match_{f}") for f in SCORED_FIELDS]
    any_judged = F.coalesce(*every).isNotNull()
    any_wrong = F.least(*[F.coalesce(m, F.lit(True)) for m in every]) == F.lit(False)
    return scored.withColumns(
        {
            "judged_for_correction": F.col("failed") | any_judged,
            "needs_correction": F.col("failed") | any_wrong,
            "judged_for_hallucination": F.coalesce(F.col("has_null_label"), F.lit(False)),
        }
    ).drop("has_null_label", *[f"label_{f}" for f in SCORED_FIELDS])


def _share(flag: Column, among: Column | None = None) -> Column:
    as_number = flag.cast("int")
    return F.avg(as_number if among is None else F.when(among, as_number))


def model_report(scored: DataFrame, keys: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """One row per model. Every measure is a partial aggregate over one scan."""
    complete = F.col("timing_complete")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        *[_share(F.col(f"match_{f}")).alias(f"accuracy_{f}") for f in SCORED_FIELDS],
        F.coalesce(_share(F.col("failed")), F.lit(0.0)).alias("failure_rate"),
        _share(F.col("needs_correction"), F.col("judged_for_correction")).alias("correction_rate"),
        _share(F.size("hallucinated_fields") > 0, F.col("judged_for_hallucination")).alias(
            "hallucination_rate"
        ),
        F.avg(F.when(complete, F.col("total_ms"))).alias("average_total_ms"),
        F.avg(F.when(complete, F.col("inference_ms"))).alias("average_inference_ms"),
    )


def accuracy_map(report: DataFrame) -> DataFrame:
    """The per-field accuracies of a report as one map column."""
    entries = [
        F.struct(F.lit(f).alias("key"), F.col(f"accuracy_{f}").alias("value")) for f in SCORED_FIELDS
    ]
    return report.withColumn("field_accuracy", F.map_from_entries(F.array(*entries))).drop(
        *[f"accuracy_{f}" for f in SCORED_FIELDS]
    )


def result_json(scored: DataFrame) -> DataFrame:
    """Nested result rows as JSON text, nulls kept."""
    matches = F.struct(*[F.col(f"match_{f}").alias(f) for f in SCORED_FIELDS])
    result = F.struct(
        "doc_id",
        matches.alias("field_matches"),
        "hallucinated_fields",
        "failed",
        "needs_correction",
        "timing_complete",
    )
    return scored.select(
        "model_id", "doc_id", F.to_json(result, {"ignoreNullFields": "false"}).alias("result")
    )


def upsert_reports(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of re-run models replaced, all others kept."""
    return existing.join(fresh.select("model_id").distinct(), "model_id", "left_anti").unionByName(
        fresh
    )
