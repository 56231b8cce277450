"""XML first, model for the rest: documents to file name proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.stages import settle
from fieldloom.operators import attachments as attachment_ops
from fieldloom.operators import merge, naming, prompts, responses
from fieldloom.operators.pages import assemble_pages

PHASES = {"extraction": "", "shortening": "short_"}


def calls_wide(calls: DataFrame, max_repairs: int = 1, short_repairs: int = 1) -> DataFrame:
    """All attempts of both phases of a document in one row, in one shuffle.

    calls_ignored counts calls that no attempt of the protocol stands for,
    calls_repeated those of an attempt beyond its first, short_tried tells
    whether there is any call of the shortening phase.
    """
    repairs = {"extraction": max_repairs, "shortening": short_repairs}
    cells, attempts = [], {}
    for phase, prefix in PHASES.items():
        mine = F.coalesce(F.col("phase") == phase, F.lit(False))
        cells += responses.attempt_columns(lambda k, m=mine: m & (F.col("attempt") == k), repairs[phase], prefix)
        attempts[phase] = (mine, repairs[phase])
    attempts["other"] = (~F.coalesce(F.col("phase").isin(*PHASES), F.lit(False)), -1)
    tried = (F.count_if(attempts["shortening"][0]) > 0).alias("short_tried")
    return calls.groupBy("doc_id").agg(*cells, *responses.attempt_counts(attempts), tried)


def _fact(name: str) -> Column:
    return F.col(f"facts.{name}")


def _page_counters(pages: DataFrame) -> DataFrame:
    """Pages of each document and the numbers of those that needed recognition."""
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_pages"),
        F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page_number").cast("long")))).alias("_ocr"),
    )


def gather(
    documents: DataFrame, attachments: DataFrame, calls: DataFrame, max_repairs: int = 1, short_repairs: int = 1
) -> DataFrame:
    """One row per document: the counts of its attachments, its first XML content, and all its calls."""
    wide = calls_wide(responses.usable_completions(calls), max_repairs, short_repairs)
    counted = attachment_ops.count_attachments(documents.select("doc_id", "extension", "shorten"), attachments)
    return counted.join(wide, "doc_id", "left")


def _route(gathered: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """Which source each gathered document is read from; images hold no XML."""
    calls = [c for c in gathered.columns if c.startswith(("response_", "error_", "short_", "calls_"))]
    joined = attachment_ops.classify(gathered, "extension", "shorten", *calls, *kept)
    found = ("xml_attachment_name", "xml_profile_id", "xml_warning", "facts")
    held = joined.withColumns({c: F.when(~_is_image(), F.col(c)) for c in found}).withColumn(
        "xml_status", F.when(_is_image(), F.lit("none")).otherwise(F.col("xml_status"))
    )
    complete = merge.supplies_filename(_fact)
    return settle(
        held,
        {
            "complete": complete & F.col("facts").isNotNull(),
            "xml_fields_used": merge.fields_used(_fact),
        },
    )


def _is_image() -> Column:
    return F.lower("extension").isin(".jpg", ".jpeg")


def _resolved(routed: DataFrame, max_repairs: int) -> DataFrame:
    """The state of each document's extraction; nothing is asked where XML answers alone."""
    masked = routed.withColumns(
        {
            f"{kind}_{k}": F.when(~F.col("complete"), F.col(f"{kind}_{k}"))
            for k in range(max_repairs + 1)
            for kind in ("response", "error")
        }
    )
    return responses.resolve_attempts(masked, max_repairs)


def _crashed() -> Column:
    """The model raised where it was asked."""
    return ~F.col("complete") & F.col("crashed").isNotNull()


def _used_model() -> Column:
    return ~F.col("complete") & F.col("crashed").isNull()


def _model_value(name: str) -> Column:
    return F.when(_used_model(), F.col(f"value.{name}"))


def _state() -> Column:
    """``done``, ``failed`` or ``awaiting``, of a resolved document."""
    return (
        F.when(F.col("complete"), F.lit("done"))
        .when(_crashed() & (F.size("xml_fields_used") > 0), F.lit("done"))
        .when(_crashed(), F.lit("failed"))
        .when(F.col("mode") != "done", F.lit("awaiting"))
        .otherwise(F.lit("done"))
    )


def analyse(
    documents: DataFrame,
    attachments: DataFrame,
    calls: DataFrame,
    max_repairs: int = 1,
    short_repairs: int = 1,
    pages: DataFrame | None = None,
) -> DataFrame:
    """One proposal row per document.

    ``documents``: doc_id, extension, shorten. ``attachments``: doc_id,
    attachment_name, revision_no, content. ``calls``: doc_id, phase, attempt,
    response, finish_reason, error. ``pages``: routed pages (``route_pages``);
    with them the result has pages_total and pages_ocr. Documents that XML
    answers alone are not read, so no page of theirs counts as recognised. An
    image (extension .jpg or .jpeg) is one recognised page and holds no XML.

    Discovery and the calls are each brought to one row per document; the rest
    is projection. Responses of documents that XML answers alone are blanked
    before they would be parsed. ``state`` is ``done``, ``failed`` (the model
    raised and XML held nothing), or ``awaiting`` an answer. calls_ignored and
    calls_repeated count calls that took no part.
    """
    routed = _route(gather(documents, attachments, calls, max_repairs, short_repairs))
    if pages is not None:
        routed = routed.join(_page_counters(pages), "doc_id", "left")
    return _conclude(routed, max_repairs, short_repairs, pages is not None)


def conclude(gathered: DataFrame, max_repairs: int = 1, short_repairs: int = 1, kept: tuple[str, ...] = ()) -> DataFrame:
    """Gathered documents to proposal rows, as ``analyse``; a projection, for tables and streams.

    ``kept`` columns of ``gathered`` stay, behind the others.
    """
    return _conclude(_route(gathered, kept), max_repairs, short_repairs, False, kept)


def _conclude(
    routed: DataFrame, max_repairs: int, short_repairs: int, paged: bool, kept: tuple[str, ...] = ()
) -> DataFrame:
    image = _is_image()
    resolved = _resolved(routed, max_repairs)
    crashed, used_model = _crashed(), _used_model()
    model = _model_value
    merged = merge.merged_columns(F.col("facts").isNotNull(), _fact, model)
    # Document warnings go before the model's own: discovery first.
    discovery_warning = F.when(used_model, F.array_compact(F.array("xml_warning")))
    fallback = F.array_compact(
        F.array(F.when(crashed, F.concat(F.lit("model fallback failed: "), F.col("crashed"))))
    )
    merged["warnings"] = merge.concat_warnings(
        _fact("warnings"), discovery_warning, model("warnings"), fallback
    )
    values = settle(
        resolved,
        {
            **merged,
            "state": _state(),
            "fallback_used": crashed,
            "extraction_source": F.when(crashed, F.lit("xml")).otherwise(
                merge.extraction_source(F.size("xml_fields_used"), F.col("complete"))
            ),
        },
    ).drop("facts", "value", "asked", "rejected")

    shortenable = F.col("shorten") & ~F.col("fallback_used")
    gated = values.withColumns(
        {
            f"short_{kind}_{k}": F.when(shortenable, F.col(f"short_{kind}_{k}"))
            for k in range(short_repairs + 1)
            for kind in ("response", "error")
        }
    )
    short_failed = F.coalesce(*[F.col(f"short_error_{k}") for k in range(short_repairs + 1)])
    shortened = responses.apply_short_names(gated, short_repairs).withColumn(
        "inference_ran", F.when(F.col("complete"), shortenable & short_failed.isNull()).otherwise(True)
    )
    proposals = naming.propose_filenames(shortened, F.col("extension"))
    failed = F.col("state") == "failed"
    counters = []
    if paged:
        nothing = F.array().cast("array<bigint>")
        total = F.when(image, 1).otherwise(F.coalesce("_pages", F.lit(0))).cast("bigint")
        read = F.when(image, F.array(F.lit(1).cast("bigint"))).when(F.col("complete"), nothing)
        counters = [
            total.alias("pages_total"),
            read.otherwise(F.coalesce("_ocr", nothing)).alias("pages_ocr"),
        ]
    return proposals.select(
        "doc_id",
        "state",
        F.when(failed, F.col("crashed")).alias("error"),
        *merge.FILENAME_FIELDS,
        "seller_short",
        "product_summary_short",
        "language",
        "evidence",
        "warnings",
        "extraction_source",
        "inference_ran",
        "xml_status",
        "xml_attachment_name",
        "xml_profile_id",
        "xml_fields_used",
        F.when(~failed, F.col("proposed_filename")).alias("proposed_filename"),
        "missing_fields",
        "naming_warnings",
        "requires_review",
        (F.col("shorten") & ~F.col("fallback_used") & (F.col("state") == "done")).alias("shortenable"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("calls_ignored", "calls_repeated")),
        *counters,
        *kept,
    )


def split_results(analysed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(proposals, dead letters, documents still awaiting an answer)."""
    by = lambda s: analysed.filter(F.col("state") == s)
    return by("done"), by("failed"), by("awaiting")


def next_prompts(
    documents: DataFrame,
    attachments: DataFrame,
    calls: DataFrame,
    pages: DataFrame,
    max_repairs: int = 1,
    short_repairs: int = 1,
) -> DataFrame:
    """Every prompt the analysis still waits for: doc_id, phase, attempt, prompt.

    Takes what ``analyse`` takes. A document that awaits an answer gets the
    prompt of its state (extraction, a repair of everything, or of the fields
    still missing), over all its pages; one that is done and may be shortened
    gets its shortening prompt, once. Scored and appended to ``calls``, the
    answers take the analysis on, until no prompt is left.
    """
    resolved = _resolved(_route(gather(documents, attachments, calls, max_repairs, short_repairs)), max_repairs)
    # A document awaits an answer or is done, so that one pass tells its one prompt.
    merged = merge.merged_columns(F.col("facts").isNotNull(), _fact, _model_value)
    told = settle(
        resolved.withColumn("_last", prompts.last_response(resolved)),
        {
            "seller": merged["seller"],
            "product_summary": merged["product_summary"],
            "_state": _state(),
            "_untried": F.col("shorten") & ~_crashed() & ~F.coalesce("short_tried", F.lit(False)),
        },
    )
    shortened = (F.col("_state") == "done") & F.col("_untried") & prompts.can_shorten()
    phase = F.when(F.col("_state") == "awaiting", F.lit("extraction")).when(shortened, F.lit("shortening"))
    state = ("attempts", "mode", "asked", "rejected", "fault", "_last", "seller", "product_summary")
    waiting = settle(told, {"phase": phase}).select("doc_id", "phase", *state).where(F.col("phase").isNotNull())
    assembled = assemble_pages(pages).select(F.col("doc_id").alias("_read"), "pages")
    asks = F.col("phase") == "extraction"
    read = waiting.join(assembled, (F.col("doc_id") == F.col("_read")) & asks, "left")
    none = F.array().cast(assembled.schema["pages"].dataType)
    extraction = prompts.next_extraction(F.col("_last"))
    shortening = prompts.shorten_prompt(F.col("seller"), F.col("product_summary"))
    return read.withColumn("pages", F.coalesce("pages", none)).select(
        "doc_id",
        "phase",
        F.when(asks, F.col("attempts")).otherwise(0).alias("attempt"),
        F.when(asks, extraction).otherwise(shortening).alias("prompt"),
    )
