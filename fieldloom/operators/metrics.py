"""Run metrics: constraints, provenance texts and call labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.values import present_names
from fieldloom.operators.ordered import position

TIMINGS = ("total_ms", "pdf_extraction_ms", "ocr_ms", "inference_ms", "xml_ms")
FILENAME_FIELD_COUNT = 5

# Texts that describe where the values of a run came from.
SOURCE_LABELS = {
    "xml": "ZUGFeRD / Factur-X XML",
    "xml_and_model": "XML + AI",
    "model": "Document text + AI",
}
PHASE_LABELS = {"extraction": "Extraction", "shortening": "Shortening"}


def violations(runs: DataFrame) -> Column:
    """Names of the constraints a run breaks; columns it lacks are not checked."""
    has = set(runs.columns)
    below = lambda c: F.coalesce(F.col(c) < 0, F.lit(False))
    checks = [(c, below(c)) for c in TIMINGS if c in has]
    checks += [("pages_total", F.coalesce(F.col("pages_total") < 1, F.lit(False)))]
    checks += [(c, below(c)) for c in ("input_tokens", "output_tokens") if c in has]
    if "tokens_per_second" in has:
        rate = F.col("tokens_per_second")
        bad = (rate < 0) | F.isnan(rate) | (rate == float("inf"))
        checks.append(("tokens_per_second", F.coalesce(bad, F.lit(False))))
    if "pages_ocr" in has:
        inside = F.forall("pages_ocr", lambda p: p.between(1, F.col("pages_total")))
        checks.append(("pages_ocr", F.coalesce(~inside, F.lit(False))))
    return present_names(checks)


def split_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) runs."""
    checked = runs.withColumn("violations", violations(runs))
    return checked.filter(F.size("violations") == 0), checked.filter(F.size("violations") > 0)


def source_label(source: Column, pages_ocr: Column) -> Column:
    pairs = [F.lit(part) for item in SOURCE_LABELS.items() for part in item]
    label = F.element_at(F.create_map(*pairs), source)
    return F.when(F.size(pages_ocr) > 0, F.concat(label, F.lit(" (OCR)"))).otherwise(label)


def xml_detection(status: Column, n_fields: Column, profile_id: Column) -> Column:
    """What embedded XML was found; null when none was."""
    # The texts of the messages below are results that must come out the same.
    return (
        F.when(
            status == "supported",
            F.format_string(f"Detected and used (%d of {FILENAME_FIELD_COUNT} fields)", n_fields),
        )
        .when(
            (status == "unsupported") & (F.coalesce(profile_id, F.lit("")) != ""),
            F.concat(
                F.lit("Detected but uses an unsupported invoice profile ("),
                profile_id,
                F.lit("); used AI instead"),
            ),
        )
        .when(
            status == "unsupported",
            F.lit("Detected but not a supported invoice format; used AI instead"),
        )
        .when(status == "invalid", F.lit("Detected but not valid XML; used AI instead"))
        .when(
            status == "ambiguous",
            F.lit("Multiple different invoice XML attachments found; used AI instead"),
        )
    )


def label_calls(calls: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Numbers the calls of a run within their phase and labels them."""
    numbered = position(calls, [*keys, "phase"], "call_no", "phase_index")
    pairs = [F.lit(part) for item in PHASE_LABELS.items() for part in item]
    phase = F.element_at(F.create_map(*pairs), F.col("phase"))
    ordinal = F.when(F.col("phase_index") == 0, phase).otherwise(
        F.concat(phase, F.lit(" retry "), F.col("phase_index").cast("string"))
    )
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return numbered.withColumn(
        "label", F.when(failed, F.concat(ordinal, F.lit(" — failed"))).otherwise(ordinal)
    )


def assemble_metrics(stages: DataFrame) -> DataFrame:
    """Stage clocks to run metrics: reading time without OCR, and the total."""
    ms = lambda c: F.coalesce(F.col(c), F.lit(0))
    timed = stages.withColumn(
        "pdf_extraction_ms", F.greatest(ms("read_ms") - ms("ocr_ms"), F.lit(0))
    )
    return timed.withColumn(
        "total_ms", ms("xml_ms") + F.col("pdf_extraction_ms") + ms("ocr_ms") + ms("inference_ms")
    ).drop("read_ms")
