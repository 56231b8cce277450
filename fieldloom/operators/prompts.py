"""Prompt rows for any batch text scorer, and the scorer seam.

The wording is this project's own. What is kept from the protocol is the
structure: page texts first, one instruction per field in a fixed order, the
previous value and the reason it was refused on a repair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.pages import pages_block
from fieldloom.operators.responses import ASKED_FIELDS, NOT_FOUND

INSTRUCTIONS = {
    "invoice_date": (
        "- invoice_date: the day the invoice was issued, as YYYY-MM-DD whatever notation the "
        "document uses; null if unclear"
    ),
    "seller": (
        "- seller: who sells, not a marketplace or payment service; letters, digits, hyphens "
        "and underscores only; null if unclear"
    ),
    "product_summary": (
        "- product_summary: the main product, or a few words on all of them, in the language of "
        "the document; letters, digits, hyphens and underscores only; null if unclear"
    ),
    "gross_total": (
        "- gross_total: the amount to pay including tax, as a plain number with a decimal point; "
        "never the net amount; null if unclear"
    ),
    "currency": "- currency: the three-letter ISO-4217 code; null if unclear",
    "language": '- language: "de", "en" or "unknown"',
}
CURRENCY_HINT = "  A currency code such as EUR, USD or GBP, not the language."
EXTRACT = "Read the document above and answer with one JSON object that has exactly these keys:"
REPAIR = "Read the document above again and answer with one JSON object for these keys only:"
CLOSING = "Use null rather than guess. Answer with the JSON object alone, without fences or comments."
SHORTEN = (
    "Shorten the two values above for use in a file name. Answer with one JSON object with the keys "
    "seller_short (the brand in one or two words) and product_short (the core product in two to four "
    "words). Keep the language, add nothing, and use null where the value above is null.\n\n" + CLOSING
)


def extraction_prompt(pages: Column) -> Column:
    body = "\n\n".join([EXTRACT, "\n".join(INSTRUCTIONS[f] for f in ASKED_FIELDS), CLOSING])
    return F.concat(pages_block(pages), F.lit("\n\n" + body))


def _repair_block(field: str, message: Column, previous: Column) -> Column:
    lines = [F.lit(INSTRUCTIONS[field])]
    if field == "currency":
        lines.append(F.lit(CURRENCY_HINT))
    reason = F.when(previous.isNull(), F.concat(F.lit("  "), message)).otherwise(
        F.concat(F.lit("  Previous answer: "), previous, F.lit(" - "), message)
    )
    return F.concat_ws("\n", *lines, reason)


def field_repair_prompt(pages: Column, asked: Column, rejected: Column) -> Column:
    """Asks again for the ``asked`` fields, in the fixed order.

    ``rejected`` holds (field, message, previous) for refused values; a field
    without an entry was left empty.
    """
    def refusal(field: str) -> Column:
        return F.get(F.filter(rejected, lambda r: r["field"] == field), 0)

    blocks = []
    for field in ASKED_FIELDS:
        entry = refusal(field)
        message = F.coalesce(entry["message"], F.lit(NOT_FOUND))
        blocks.append(
            F.when(F.array_contains(asked, field), _repair_block(field, message, entry["previous"]))
        )
    return F.concat(
        pages_block(pages),
        F.lit(f"\n\n{REPAIR}\n\n"),
        F.array_join(F.array_compact(F.array(*blocks)), "\n"),
        F.lit(f"\n\n{CLOSING}"),
    )


def full_repair_prompt(original: Column, response: Column, fault: Column) -> Column:
    """Everything again, with the refused response and why it was refused."""
    return F.concat(
        original,
        F.lit("\n\nThe last answer could not be used.\n\nLast answer:\n"),
        F.coalesce(response, F.lit("")),
        F.lit("\n\nReason:\n"),
        F.coalesce(fault, F.lit("")),
        F.lit("\n\n" + CLOSING),
    )


def shorten_prompt(seller: Column, product: Column) -> Column:
    return F.concat(
        F.lit("seller: "),
        F.coalesce(seller, F.lit("null")),
        F.lit("\nproduct_summary: "),
        F.coalesce(product, F.lit("null")),
        F.lit("\n\n" + SHORTEN),
    )


def can_shorten() -> Column:
    return F.col("seller").isNotNull() | F.col("product_summary").isNotNull()


def pending_shortening(analysed: DataFrame, calls: DataFrame) -> DataFrame:
    """The shortening prompt of every analysed document that has none answered yet.

    Documents without seller and product have nothing to shorten, and those
    saved by their XML after a failed call are not sent again.
    """
    tried = calls.filter(F.col("phase") == "shortening").select("doc_id").distinct()
    return (
        analysed.filter(F.col("shortenable") & can_shorten())
        .join(tried, "doc_id", "left_anti")
        .select(
            "doc_id",
            F.lit("shortening").alias("phase"),
            F.lit(0).alias("attempt"),
            shorten_prompt(F.col("seller"), F.col("product_summary")).alias("prompt"),
        )
    )


def last_response(states: DataFrame) -> Column:
    """The response of the highest attempt that has one."""
    return F.coalesce(
        *[F.col(c) for c in sorted((c for c in states.columns if c.startswith("response_")), reverse=True)]
    )


def next_extraction(last: Column) -> Column:
    """The prompt that an unfinished state asks for; ``last`` is its last response."""
    original = extraction_prompt(F.col("pages"))
    return (
        F.when(F.col("attempts") == 0, original)
        .when(F.col("mode") == "narrow", field_repair_prompt(F.col("pages"), F.col("asked"), F.col("rejected")))
        .otherwise(full_repair_prompt(original, last, F.col("fault")))
    )


def pending_prompts(states: DataFrame) -> DataFrame:
    """The next prompt of every document that still needs an answer.

    ``states`` joins ``resolve_attempts`` output with the assembled pages.
    """
    return states.filter(F.col("mode") != "done").select(
        "doc_id",
        F.lit("extraction").alias("phase"),
        F.col("attempts").alias("attempt"),
        next_extraction(last_response(states)).alias("prompt"),
    )


def _once(load: Callable[[], Callable]) -> Callable:
    """Calls the loaded function and gives (result, error); loads once, at the first call."""
    loaded: list = []

    def call(value):
        try:
            if not loaded:
                try:
                    loaded.append((load(), None))
                except Exception as error:  # noqa: BLE001 - recorded with every call
                    loaded.append((None, repr(error)))
            function, fault = loaded[0]
            return (None, fault) if fault else (function(value), None)
        except Exception as error:  # noqa: BLE001 - recorded with the call
            return None, repr(error)

    return call


def score_prompts(
    prompts: DataFrame, load_scorer: Callable[[], Callable[[str], str]]
) -> DataFrame:
    """Runs a user's scorer over prompt rows and records every call.

    ``load_scorer`` is called once per partition, on its first row, so a
    partition without prompts loads nothing. A raised error becomes the
    call's ``error`` and fails neither the row nor the task; a failed load is
    not tried again and is the error of every row of the partition.
    """
    kept = [f for f in prompts.schema.fields if f.name not in ("response", "error")]
    names = [f.name for f in kept]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator) -> Iterator:
        score = _once(load_scorer)
        for pdf in batches:
            results = [score(prompt) for prompt in pdf["prompt"]]
            yield pdf[names].assign(
                response=[r for r, _ in results], error=[error for _, error in results]
            )

    return prompts.mapInPandas(run, f"{ddl}, response string, error string")


#: Scorers of this worker process by name, with the error of a failed load.
_SCORERS: dict[str, tuple[Callable | None, str | None]] = {}


def _shared(name: str, load: Callable[[], Callable]) -> tuple[Callable | None, str | None]:
    if name not in _SCORERS:
        try:
            _SCORERS[name] = (load(), None)
        except Exception as error:  # noqa: BLE001 - recorded with every call
            _SCORERS[name] = (None, repr(error))
    return _SCORERS[name]


def length_buckets(lengths: list[int], most: int, most_chars: int) -> Iterator[list[int]]:
    """Places of prompts of like length: ``most`` at once, and ``most_chars`` when padded to the longest."""
    held: list[int] = []
    for place in sorted(range(len(lengths)), key=lengths.__getitem__):
        if held and (len(held) >= most or lengths[place] * (len(held) + 1) > most_chars):
            yield held
            held = []
        held.append(place)
    if held:
        yield held


def _score_frame(scorer: Callable[[list[str]], list], texts: list[str | None], most: int, most_chars: int) -> list[tuple]:
    """(response, error) of each text; a batch that raises is tried again prompt by prompt."""
    results: list[tuple] = [(None, "there is no prompt")] * len(texts)

    def ask(places: list[int]) -> None:
        try:
            answers = list(scorer([texts[i] for i in places]))
            if len(answers) != len(places):
                raise ValueError(f"{len(answers)} answers to {len(places)} prompts")
        except Exception as error:  # noqa: BLE001 - recorded with the call
            if len(places) > 1:
                for i in places:
                    ask([i])
            else:
                results[places[0]] = (None, repr(error))
            return
        for i, answer in zip(places, answers):
            results[i] = (None, repr(answer)) if isinstance(answer, Exception) else (answer, None)

    given = [i for i, text in enumerate(texts) if text is not None]
    for bucket in length_buckets([len(texts[i]) for i in given], most, most_chars):
        ask([given[k] for k in bucket])
    return results


def score_batches(
    prompts: DataFrame,
    name: str,
    load_scorer: Callable[[], Callable[[list[str]], list]],
    most: int = 32,
    most_chars: int = 1 << 18,
) -> DataFrame:
    """Runs a user's batch scorer over prompt rows and records every call.

    The scorer takes a list of prompts and gives as many answers; an exception
    among them is the error of its prompt alone. Prompts of a frame go to it in
    batches of like length. ``load_scorer`` is called once per worker process
    and ``name``, whatever the number of tasks; the scorer then stays loaded. A
    failed load is not tried again and is the error of every row.
    """
    kept = [f for f in prompts.schema.fields if f.name not in ("response", "error")]
    names = [f.name for f in kept]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator) -> Iterator:
        from fieldloom.operators import prompts as here  # the process's own module, not a copy of it

        for pdf in batches:
            if not len(pdf):
                continue
            scorer, fault = here._shared(name, load_scorer)
            if fault:
                results = [(None, fault)] * len(pdf)
            else:
                results = here._score_frame(scorer, pdf["prompt"].tolist(), most, most_chars)
            yield pdf[names].assign(response=[r for r, _ in results], error=[error for _, error in results])

    return prompts.mapInPandas(run, f"{ddl}, response string, error string")


def recognise_pages(
    pages: DataFrame, load_recogniser: Callable[[], Callable[[bytes], tuple[str, float | None]]]
) -> DataFrame:
    """Runs a user's recogniser over sparse pages only.

    ``pages`` has doc_id, page_number, image and needs_ocr; the filter sits
    below the Python step because Spark pushes none through it. A page that
    cannot be recognised, or has no image, is a row with ``error``; the others
    go on. The keys keep their types.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator) -> Iterator:
        recognise = _once(load_recogniser)
        for pdf in batches:
            results = [
                recognise(bytes(image)) if image is not None else (None, "the page has no image")
                for image in pdf["image"]
            ]
            out = pdf[["doc_id", "page_number"]].assign(
                ocr_text=[r[0] if r else None for r, _ in results],
                ocr_confidence=[r[1] if r else None for r, _ in results],
                error=[error for _, error in results],
            )
            yield out.astype({"ocr_confidence": "float64"})

    sparse = pages.filter("needs_ocr").select("doc_id", "page_number", "image")
    return sparse.mapInPandas(
        run,
        f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, ocr_text string,"
        " ocr_confidence double, error string",
    )
