"""Text-model responses to validated fields: parse, salvage, repair, shorten.

Responses are rows. An attempt never triggers a call here; it reads the row
with that attempt number, so the whole repair protocol is one shuffle (the
attempts of a document side by side) followed by projections.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.stages import settle
from fieldloom.functions.text import bounded_echo, has_text, quoted_echo, strip_fence, ustrip
from fieldloom.functions.values import AMOUNT_TYPE, is_currency, is_currency_shape, strict_date

# Field order, and which fields make a partial answer worth keeping.
ASKED_FIELDS = ("invoice_date", "seller", "product_summary", "gross_total", "currency", "language")
USEFUL_FIELDS = ASKED_FIELDS[:5]
LANGUAGES = ("de", "en", "unknown")
MESSAGE_LIMIT = 50
RAW_RESPONSE_LIMIT = 500

NOT_FOUND = "nothing was given; look for it on other pages or under another name"

# Our own message catalogue for rejected values.
NOT_A_DATE = "must be a date written as YYYY-MM-DD"
NOT_A_STRING = "must be a string"
NOT_A_NUMBER = "must be a decimal number"
NEGATIVE = "a total below zero is not accepted"
NOT_A_CODE = "three capital letters of a currency are expected"
NOT_A_LANGUAGE = "must be 'de', 'en' or 'unknown'"
NOT_EVIDENCE = "must be an object of evidence entries"
NOT_JSON = "response is not valid JSON"
NOT_AN_OBJECT = "response is not a JSON object"

EVIDENCE_TYPE = "map<string,struct<page:int,excerpt:string,xml_field:string>>"
REJECTED_TYPE = "array<struct<field:string,message:string,previous:string>>"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


# ---- completions -----------------------------------------------------------


def usable_completions(calls: DataFrame) -> DataFrame:
    """Replaces cut-off and blank completions by a text that is not JSON."""
    cut_off = F.concat(
        F.lit("<incomplete completion: token limit reached before the end, text="),
        quoted_echo(F.col("response")),
        F.lit(">"),
    )
    blank = F.concat(F.lit("<empty completion: text="), quoted_echo(F.col("response")), F.lit(">"))
    return calls.withColumn(
        "response",
        F.when(F.col("finish_reason") == "length", cut_off)
        .when(F.col("response").isNotNull() & ~has_text(F.col("response")), blank)
        .otherwise(F.col("response")),
    )


# ---- one response ----------------------------------------------------------


def parse_object(rows: DataFrame, response: str, out: str) -> DataFrame:
    """Adds ``out`` (VARIANT object or null) and ``out_fault``.

    The parser stops after the first value, so text after it would go
    unnoticed. Wrapped once as a list and once as a member, a response with
    anything extra breaks at least one of the two.
    """
    body, listed, member = f"_{out}_body", f"_{out}_list", f"_{out}_member"
    wrapped = (
        rows.withColumn(body, strip_fence(F.col(response)))
        .withColumns(
            {
                listed: F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit("]"))),
                member: F.try_parse_json(
                    F.concat(F.lit('{"r":'), F.col(body), F.lit("}"))
                ).isNotNull(),
            }
        )
        .withColumn(out, F.when(F.col(member), F.try_variant_get(listed, "$[0]", "variant")))
    )
    is_object = F.schema_of_variant(F.col(out)).startswith("OBJECT")
    fault = (
        F.when(F.col(response).isNull(), _null("string"))
        .when(F.col(out).isNull(), F.lit(NOT_JSON))
        .when(~is_object, F.lit(NOT_AN_OBJECT))
    )
    return (
        wrapped.withColumn(f"{out}_fault", fault)
        .withColumn(out, F.when(F.col(f"{out}_fault").isNull(), F.col(out)))
        .drop(body, listed, member)
    )


def _kind(name: str) -> Column:
    return F.col(f"_kind_{name}")


def _text(name: str) -> Column:
    return F.col(f"_text_{name}")


def _absent(name: str) -> Column:
    return _kind(name).isNull() | (_kind(name) == "VOID")


def validate_fields(rows: DataFrame, variant: str, out: str) -> DataFrame:
    """Adds the struct ``out``: a value per field, and what was rejected why.

    The JSON type of each value is checked before it is read, because reading
    alone would turn numbers and lists into strings.
    """
    names = (*ASKED_FIELDS, "evidence")
    typed = rows.withColumns(
        {
            f"_kind_{n}": F.schema_of_variant(F.try_variant_get(variant, f"$.{n}", "variant"))
            for n in names
        }
    ).withColumns(
        {
            **{f"_text_{n}": F.try_variant_get(variant, f"$.{n}", "string") for n in names},
            "_amount": F.try_variant_get(variant, "$.gross_total", AMOUNT_TYPE),
            "_evidence": F.try_variant_get(variant, "$.evidence", EVIDENCE_TYPE),
        }
    )
    text = _kind("gross_total") == "STRING"
    number = _kind("gross_total").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    written = ustrip(_text("gross_total")).rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\z")
    amount = F.when(number | (text & written), F.col("_amount"))
    is_text = {n: _kind(n) == "STRING" for n in names}
    checked = typed.withColumns(
        {
            "_v_invoice_date": F.when(is_text["invoice_date"], strict_date(_text("invoice_date"))),
            "_v_seller": F.when(is_text["seller"], _text("seller")),
            "_v_product_summary": F.when(is_text["product_summary"], _text("product_summary")),
            "_v_gross_total": F.when(amount >= 0, amount),
            "_v_currency": F.when(
                is_text["currency"] & is_currency(_text("currency")), _text("currency")
            ),
            "_v_language": F.when(
                is_text["language"] & _text("language").isin(*LANGUAGES), _text("language")
            ),
            "_below_zero": amount < 0,
        }
    )
    value = lambda n: F.col(f"_v_{n}")
    nested = _kind("evidence").startswith("OBJECT") & F.col("_evidence").isNotNull()
    errors = {
        "invoice_date": F.when(~_absent("invoice_date") & value("invoice_date").isNull(), F.lit(NOT_A_DATE)),
        "seller": F.when(~_absent("seller") & ~is_text["seller"], F.lit(NOT_A_STRING)),
        "product_summary": F.when(
            ~_absent("product_summary") & ~is_text["product_summary"], F.lit(NOT_A_STRING)
        ),
        "gross_total": F.when(
            ~_absent("gross_total") & value("gross_total").isNull(),
            F.when(F.col("_below_zero"), F.lit(NEGATIVE)).otherwise(F.lit(NOT_A_NUMBER)),
        ),
        "currency": F.when(
            ~_absent("currency") & value("currency").isNull(),
            F.when(~is_text["currency"], F.lit(NOT_A_STRING))
            .when(~is_currency_shape(_text("currency")), F.lit(NOT_A_CODE))
            .otherwise(
                F.concat(
                    quoted_echo(_text("currency")),
                    F.lit(" names no currency in use"),
                )
            ),
        ),
        "language": F.when(
            _kind("language").isNotNull() & value("language").isNull(), F.lit(NOT_A_LANGUAGE)
        ),
        "evidence": F.when(_kind("evidence").isNotNull() & ~nested, F.lit(NOT_EVIDENCE)),
    }
    rejected = F.array_compact(
        F.array(
            *[
                F.when(
                    message.isNotNull(),
                    F.struct(
                        F.lit(n).alias("field"),
                        message.alias("message"),
                        F.to_json(F.try_variant_get(variant, f"$.{n}", "variant")).alias("previous"),
                    ),
                )
                for n, message in errors.items()
            ]
        )
    )
    result = F.struct(
        *[value(n).alias(n) for n in ASKED_FIELDS],
        F.when(nested, F.col("_evidence")).alias("evidence"),
        rejected.alias("rejected"),
    )
    return checked.withColumn(out, result).select(*[c for c in rows.columns if c != out], out)


def usable_flags(value: Column) -> dict[str, Column]:
    """Which filename fields of a struct hold something; zero counts."""
    return {
        n: has_text(value[n]) if n in ("seller", "product_summary", "currency") else value[n].isNotNull()
        for n in USEFUL_FIELDS
    }


def usable_count(value: Column) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in usable_flags(value).values()])


def unfilled(value: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(~flag, F.lit(n)) for n, flag in usable_flags(value).items()])
    )


def parse_responses(rows: DataFrame, response: str, out: str = "answer") -> DataFrame:
    """Adds the struct ``out``: verdict, fault, field values, rejections, warnings.

    verdict is ``ok``, ``salvaged`` (rejected fields dropped, something useful
    left), ``failed``, or null where there is no response.
    """
    parsed = parse_object(rows, response, "_variant")
    checked = validate_fields(parsed, "_variant", "_fields")
    counted = checked.withColumn("_usable", usable_count(F.col("_fields")))
    rejected = F.col("_fields.rejected")
    verdict = (
        F.when(F.col(response).isNull(), _null("string"))
        .when(F.col("_variant_fault").isNotNull(), F.lit("failed"))
        .when(F.size(rejected) == 0, F.lit("ok"))
        .when(F.col("_usable") > 0, F.lit("salvaged"))
        .otherwise(F.lit("failed"))
    )
    listed = F.array_join(
        F.transform(rejected, lambda r: F.concat_ws(": ", r["field"], r["message"])), "; "
    )
    fault = F.when(
        verdict == "failed",
        F.coalesce(F.col("_variant_fault"), F.concat(F.lit("no usable field: "), listed)),
    )
    warnings = F.transform(
        rejected,
        lambda r: F.concat(r["field"], F.lit(": "), bounded_echo(r["message"], MESSAGE_LIMIT)),
    )
    answer = F.struct(
        verdict.alias("verdict"),
        fault.alias("fault"),
        F.col("_usable").alias("usable"),
        *[F.col(f"_fields.{n}").alias(n) for n in (*ASKED_FIELDS, "evidence")],
        rejected.alias("rejected"),
        warnings.alias("warnings"),
    )
    return settle(counted, {out: answer}).drop("_variant", "_variant_fault", "_fields", "_usable")


def best_salvage(answers: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the salvaged attempt with most usable fields; ties keep the earlier."""
    salvaged = answers.filter(F.col("answer.verdict") == "salvaged")
    order = Window.partitionBy(*keys).orderBy(F.col("answer.usable").desc(), F.col("attempt"))
    return (
        salvaged.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def rejected_fields(answers: DataFrame) -> DataFrame:
    """(doc_id, field, message, previous): the first rejection per field."""
    exploded = answers.select("doc_id", F.posexplode("answer.rejected").alias("pos", "r"))
    return exploded.groupBy("doc_id", F.col("r.field").alias("field")).agg(
        F.min_by("r.message", "pos").alias("message"), F.min_by("r.previous", "pos").alias("previous")
    )


def fields_to_ask(answers: DataFrame) -> DataFrame:
    """Null fields and rejected fields in long form; a rejection wins over null."""
    empty = answers.select(
        "doc_id", F.explode(unfilled(F.col("answer"))).alias("field")
    ).withColumn("null_message", F.lit(NOT_FOUND))
    refused = rejected_fields(answers).filter(F.col("field").isin(*ASKED_FIELDS))
    return empty.join(refused, ["doc_id", "field"], "full").select(
        "doc_id",
        "field",
        F.coalesce("message", "null_message").alias("message"),
        "previous",
    )


# ---- the repair protocol ---------------------------------------------------


def attempt_columns(at: Callable[[int], Column], max_repairs: int, prefix: str = "") -> list[Column]:
    """Aggregates: for each attempt k its response_k and error_k, from one whole call.

    ``at`` says which rows are attempt k. Of several calls of one attempt the
    one with a response counts, then the one of the larger text, so that
    response and error are never taken from two calls.
    """
    order = F.struct(F.col("response").isNotNull().alias("answered"), "response", "error")
    cells = []
    for k in range(max_repairs + 1):
        chosen = F.max(F.when(at(k), order))
        cells += [chosen[name].alias(f"{prefix}{name}_{k}") for name in ("response", "error")]
    return cells


def attempt_counts(attempts: dict[str, tuple[Column, int]]) -> list[Column]:
    """Aggregates calls_ignored and calls_repeated over phases, each with its rows and max_repairs.

    Ignored are calls of attempts that the protocol does not have; repeated
    are calls of an attempt beyond its first.
    """
    ignored, repeated = F.lit(0).cast("long"), F.lit(0).cast("long")
    for mine, most in attempts.values():
        inside = F.coalesce(F.col("attempt").between(0, most), F.lit(False))
        ignored = ignored + F.count_if(mine & ~inside)
        for k in range(most + 1):
            repeated = repeated + F.greatest(F.count_if(mine & (F.col("attempt") == k)) - 1, F.lit(0))
    return [ignored.alias("calls_ignored"), repeated.alias("calls_repeated")]


def attempts_wide(calls: DataFrame, max_repairs: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: response_k and error_k for each attempt, calls_ignored and calls_repeated."""
    return calls.groupBy(*keys).agg(
        *attempt_columns(lambda k: F.col("attempt") == k, max_repairs),
        *attempt_counts({"all": (F.lit(True), max_repairs)}),
    )


def _value_of(answer: Column, warnings: Column) -> Column:
    return F.struct(
        *[answer[n].alias(n) for n in (*ASKED_FIELDS, "evidence")], warnings.alias("warnings")
    )


def _no_value() -> Column:
    fields = (
        "invoice_date:date,seller:string,product_summary:string,"
        f"gross_total:{AMOUNT_TYPE},currency:string,language:string,"
        f"evidence:{EVIDENCE_TYPE},warnings:array<string>"
    )
    return _null(f"struct<{fields}>")


def _merge_asked(value: Column, answer: Column, recovered: Column) -> Column:
    """Takes recovered fields from ``answer`` and drops their stale warnings."""
    taken = {
        n: F.when(F.array_contains(recovered, n), answer[n]).otherwise(value[n]) for n in ASKED_FIELDS
    }
    kept = F.filter(
        value["warnings"],
        lambda w: ~F.exists(recovered, lambda r: w.startswith(F.concat(r, F.lit(": ")))),
    )
    return F.struct(
        *[c.alias(n) for n, c in taken.items()],
        value["evidence"].alias("evidence"),
        kept.alias("warnings"),
    )


def _recovered(asked: Column, answer: Column) -> Column:
    flags = {**usable_flags(answer), "language": answer["language"].isNotNull()}
    good = F.array_compact(F.array(*[F.when(flag, F.lit(n)) for n, flag in flags.items()]))
    return F.array_intersect(asked, good)


def _advance(rows: DataFrame, k: int, max_repairs: int) -> DataFrame:
    """State after attempt ``k``: value, mode (full, narrow, done), asked fields."""
    last = k >= max_repairs
    parsed = parse_responses(rows, f"response_{k}", "_answer")
    answer, value, asked = F.col("_answer"), F.col("value"), F.col("asked")
    error = F.col(f"error_{k}")
    full, narrow = F.col("mode") == "full", F.col("mode") == "narrow"
    none_asked = F.array().cast("array<string>")
    verdict = answer["verdict"]
    better = value.isNull() | (answer["usable"] > usable_count(value))
    # A narrow reply is judged field by field; it only has to be an object.
    replied = verdict.isNotNull() & ~F.coalesce(answer["fault"].isin(NOT_JSON, NOT_AN_OBJECT), F.lit(False))
    staged = parsed.withColumn(
        "_gained", F.when(narrow & replied, _recovered(asked, answer)).otherwise(none_asked)
    ).withColumn(
        "_value",
        F.when(narrow & (F.size("_gained") > 0), _merge_asked(value, answer, F.col("_gained")))
        .when(full & (verdict == "ok"), _value_of(answer, none_asked))
        .when(full & (verdict == "salvaged") & better, _value_of(answer, answer["warnings"]))
        .otherwise(value),
    )
    refused = F.transform(
        F.filter(answer["rejected"], lambda r: r["field"] != "evidence"), lambda r: r["field"]
    )
    to_ask = (
        F.when(narrow, F.array_except(asked, F.col("_gained")))
        .when(full & (verdict == "ok"), unfilled(F.col("_value")))
        .when(full & (verdict == "salvaged"), F.array_union(unfilled(F.col("_value")), refused))
        .otherwise(none_asked)
    )
    staged = staged.withColumn("_asked", to_ask)
    silent = verdict.isNull() & error.isNull()
    mode = (
        F.when(F.col("mode") == "done", F.lit("done"))
        .when(silent, F.col("mode"))
        .when(full & error.isNotNull(), F.lit("done"))
        .when(F.lit(last), F.lit("done"))
        .when(full & (verdict == "failed"), F.lit("full"))
        .when(full & (verdict == "ok") & (F.size("_asked") == 0), F.lit("done"))
        .when(full & (verdict == "salvaged") & (F.size("_asked") == 0), F.lit("full"))
        .when(narrow & (F.size("_asked") == 0), F.lit("done"))
        .otherwise(F.lit("narrow"))
    )
    # Why a field has to be asked again: the newest refusal of it.
    fresh = F.filter(answer["rejected"], lambda r: full | F.array_contains(asked, r["field"]))
    older = F.filter(
        F.col("rejected"), lambda r: ~F.exists(fresh, lambda n: n["field"] == r["field"])
    )
    refusals = (
        F.when(full & (verdict == "salvaged") & better, answer["rejected"])
        .when(narrow & replied, F.concat(older, fresh))
        .otherwise(F.col("rejected"))
    )
    raw = quoted_echo(bounded_echo(F.col(f"response_{k}"), RAW_RESPONSE_LIMIT, "...(truncated)"))
    terminal = (
        F.when(F.col("_value").isNotNull() | ~full, F.col("terminal"))
        .when(error.isNotNull() & F.lit(k > 0), F.concat(F.lit("repair generation failed: "), error))
        .when(
            F.lit(last) & (verdict == "failed"),
            F.concat(answer["fault"], F.lit("; raw response: "), raw),
        )
        .otherwise(F.col("terminal"))
    )
    crashed = F.coalesce(F.col("crashed"), F.when(F.lit(k == 0), error))
    nothing_new = F.col("mode") == "done"
    settled = settle(
        staged,
        {
            "value": F.col("_value"),
            "mode": mode,
            "asked": F.when(mode == "narrow", F.col("_asked")).otherwise(none_asked),
            "rejected": F.when(nothing_new, F.col("rejected")).otherwise(refusals),
            "terminal": F.when(nothing_new, F.col("terminal")).otherwise(terminal),
            "crashed": crashed,
            "opened": verdict if k == 0 else F.col("opened"),
            "fault": F.when(nothing_new, F.col("fault")).otherwise(
                F.coalesce(answer["fault"], F.col("fault"))
            ),
            "attempts": F.col("attempts") + F.when(nothing_new | silent, 0).otherwise(1),
        },
    )
    return settled.select(*rows.columns)


def resolve_attempts(wide: DataFrame, max_repairs: int = 1) -> DataFrame:
    """Folds the attempts of each document into one extraction.

    Adds ``value`` (the fields and their warnings, null when the first call
    raised), ``crashed`` (that error), ``mode`` (``done`` or what still has to
    be asked), ``asked``, ``rejected`` (refused values, the newest of each
    field), ``opened`` (the verdict on the first response) and ``attempts``.
    """
    state = wide.select(
        "*",
        _no_value().alias("value"),
        F.lit("full").alias("mode"),
        F.array().cast("array<string>").alias("asked"),
        F.array().cast(REJECTED_TYPE).alias("rejected"),
        _null("string").alias("terminal"),
        _null("string").alias("crashed"),
        _null("string").alias("opened"),
        _null("string").alias("fault"),
        F.lit(0).alias("attempts"),
    )
    for k in range(max_repairs + 1):
        state = _advance(state, k, max_repairs)
    failed = F.struct(
        _null("date").alias("invoice_date"),
        _null("string").alias("seller"),
        _null("string").alias("product_summary"),
        _null(AMOUNT_TYPE).alias("gross_total"),
        _null("string").alias("currency"),
        _null("string").alias("language"),
        _null(EVIDENCE_TYPE).alias("evidence"),
        F.array(
            F.concat(F.lit("model output could not be validated: "), F.col("terminal"))
        ).alias("warnings"),
    )
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(
        F.col("terminal").isNotNull(), failed
    )
    return settle(state, {"value": value}).drop("terminal")


# ---- short names -----------------------------------------------------------


def _short_answer(rows: DataFrame, response: str, out: str) -> DataFrame:
    parsed = parse_object(rows, response, "_short")
    kinds = {
        n: F.schema_of_variant(F.try_variant_get("_short", f"$.{n}", "variant"))
        for n in ("seller_short", "product_short")
    }
    accepted = lambda n: kinds[n].isNull() | kinds[n].isin("VOID", "STRING")
    fault = F.coalesce(
        F.col("_short_fault"),
        F.when(~accepted("seller_short"), F.lit(f"seller_short {NOT_A_STRING}")),
        F.when(~accepted("product_short"), F.lit(f"product_short {NOT_A_STRING}")),
    )
    return parsed.withColumn(
        out,
        F.struct(
            fault.alias("fault"),
            *[F.try_variant_get("_short", f"$.{n}", "string").alias(n) for n in kinds],
        ),
    ).drop("_short", "_short_fault")


def apply_short_names(rows: DataFrame, max_repairs: int = 1) -> DataFrame:
    """Adds seller_short and product_summary_short, and any warning.

    ``rows`` holds seller, product_summary, warnings and short_response_k /
    short_error_k. A short value counts only where both it and the original
    hold text; nothing is asked when both originals are null.
    """
    staged = rows
    for k in range(max_repairs + 1):
        staged = _short_answer(staged, f"short_response_{k}", f"_short_{k}")
    wanted = F.col("seller").isNotNull() | F.col("product_summary").isNotNull()
    chosen = F.lit(None).cast("struct<fault:string,seller_short:string,product_short:string>")
    skipped = failed = F.lit(None).cast("string")
    for k in reversed(range(max_repairs + 1)):
        response, error = F.col(f"short_response_{k}"), F.col(f"short_error_{k}")
        answer = F.col(f"_short_{k}")
        valid = response.isNotNull() & answer["fault"].isNull()
        invalid = response.isNotNull() & answer["fault"].isNotNull()
        chosen = F.when(error.isNull() & valid, answer).when(error.isNull() & invalid, chosen)
        failed = F.when(error.isNotNull(), error).when(invalid, failed)
        if k == max_repairs:
            skipped = F.when(error.isNull() & invalid, answer["fault"])
        else:
            skipped = F.when(error.isNull() & invalid, skipped)
    staged = staged.withColumns({"_chosen": chosen, "_skipped": skipped, "_failed": failed})

    def gate(original: str, short: str) -> Column:
        text = F.col("_chosen")[short]
        return F.when(wanted & has_text(F.col(original)) & has_text(text), text)

    extra = F.array_compact(
        F.array(
            F.when(wanted & F.col("_skipped").isNotNull(), F.concat(F.lit("field shortening skipped: "), F.col("_skipped"))),
            F.when(wanted & F.col("_failed").isNotNull(), F.concat(F.lit("field shortening failed: "), F.col("_failed"))),
        )
    )
    helper = [f"_short_{k}" for k in range(max_repairs + 1)]
    return staged.withColumns(
        {
            "seller_short": gate("seller", "seller_short"),
            "product_summary_short": gate("product_summary", "product_short"),
            "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), extra),
        }
    ).drop("_chosen", "_skipped", "_failed", *helper)
