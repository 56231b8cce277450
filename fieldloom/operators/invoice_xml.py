"""Cross-industry invoice XML: safety checks, unique paths and field mapping.

Everything here is a projection: a document's bytes are read, checked and
mapped where they are scanned, and only the small result moves on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import (
    FIELD_TEXT_LIMIT,
    bounded_echo,
    bounded_value,
    bounded_warning,
    quoted_echo,
    too_long,
    ustrip,
)
from fieldloom.functions.values import (
    AMOUNT_LIMIT,
    AMOUNT_TYPE,
    bounded_decimal,
    compact_date,
    is_currency,
    is_decimal_text,
)
from fieldloom.operators.line_items import rank_array, summary_of_ranked
from fieldloom.operators.xml_leaves import read_leaves

# Size and nesting bounds, root namespace, accepted profile.
MAX_XML_BYTES = 10 * 1024 * 1024
MAX_XML_DEPTH = 50
ROOT_NAMESPACE = "urn:un:unece:uncefact:data:standard:CrossIndustryInvoice:100"
ROOT_NAME = "CrossIndustryInvoice"
SUPPORTED_PROFILE = "urn:cen.eu:en16931:2017"
DATE_FORMAT_CODE = "102"

# Where each field is found, reported as evidence.
_HEADER = "rsm:SupplyChainTradeTransaction"
FIELD_PATHS = {
    "invoice_date": "rsm:ExchangedDocument/ram:IssueDateTime/udt:DateTimeString",
    "seller": f"{_HEADER}/ram:ApplicableHeaderTradeAgreement/ram:SellerTradeParty/ram:Name",
    "product_summary": f"{_HEADER}/ram:IncludedSupplyChainTradeLineItem",
    "gross_total": (
        f"{_HEADER}/ram:ApplicableHeaderTradeSettlement"
        "/ram:SpecifiedTradeSettlementHeaderMonetarySummation/ram:GrandTotalAmount"
    ),
    "currency": f"{_HEADER}/ram:ApplicableHeaderTradeSettlement/ram:InvoiceCurrencyCode",
}

#: Larger documents are not handed to the quick reader, as many of them make one batch.
QUICK_BYTES = 64 * 1024

_FALLBACK = "; falling back to AI extraction"


def _repeated(**fields: str) -> str:
    inner = ",".join(f"{name}:{kind}" for name, kind in fields.items())
    return f"array<struct<{inner}>>"


_TEXTS = "array<string>"
_LINE = _repeated(
    SpecifiedTradeProduct=_repeated(Name=_TEXTS),
    SpecifiedLineTradeSettlement=_repeated(
        SpecifiedTradeSettlementLineMonetarySummation=_repeated(LineTotalAmount=_TEXTS)
    ),
)
# Every level is an array, so a path that matches twice can be told apart
# from one that matches once, even across repeated parents.
_SCHEMA = ", ".join(
    [
        "ExchangedDocumentContext "
        + _repeated(GuidelineSpecifiedDocumentContextParameter=_repeated(ID=_TEXTS)),
        "ExchangedDocument "
        + _repeated(
            IssueDateTime=_repeated(DateTimeString=_repeated(_format="string", _VALUE="string"))
        ),
        "SupplyChainTradeTransaction "
        + _repeated(
            ApplicableHeaderTradeAgreement=_repeated(SellerTradeParty=_repeated(Name=_TEXTS)),
            ApplicableHeaderTradeSettlement=_repeated(
                InvoiceCurrencyCode=_TEXTS,
                SpecifiedTradeSettlementHeaderMonetarySummation=_repeated(GrandTotalAmount=_TEXTS),
            ),
            IncludedSupplyChainTradeLineItem=_LINE,
        ),
        "_corrupt_record string",
    ]
)
_OPTIONS = {
    "ignoreNamespace": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
}


def _matches(start: Column, *path: str) -> Column:
    """All elements at ``path`` below an array of elements, in document order."""
    for step in path:
        start = F.flatten(F.filter(start.getField(step), lambda e: e.isNotNull()))
    return start


def _count(matches: Column) -> Column:
    return F.coalesce(F.size(matches), F.lit(0))


# An element within text: an empty tag, or a tag that is closed further on.
_NESTED = "(?s)<([A-Za-z_][\\w.:-]*)(?:\\s[^<>]*)?(?:/>|>.*</\\1\\s*>)"


def own_text(value: Column) -> Column:
    """The text of an element before its first inner element."""
    return F.when(value.rlike(_NESTED), F.substring_index(value, "<", 1)).otherwise(value)


def _only_text(matches: Column) -> Column:
    """The stripped text of a single match; null when empty, absent or repeated."""
    return F.when(_count(matches) == 1, F.nullif(ustrip(own_text(F.get(matches, 0))), F.lit("")))


# Fixed value: what the namespaces of an invoice have in common.
_SPACE_START = "urn:un:unece:uncefact:"
_INVOICE_SPACES = f"=\\s*[\"']{_SPACE_START}"

# ---- safety checks ---------------------------------------------------------

_ATTRIBUTES = "(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_OPEN, _CLOSE = "\x01", "\x02"


#: Code pages of one byte per character that are read besides Latin-1.
CODE_PAGES = {
    "windows-1250": "cp1250", "windows-1252": "cp1252", "cp1252": "cp1252",
    "iso-8859-2": "iso8859-2", "iso-8859-15": "iso8859-15", "latin9": "iso8859-15",
}


def _code_page(content: Column, codec: str) -> Column:
    """Latin-1 text with the characters exchanged that the code page has elsewhere."""
    latin = [chr(c) for c in range(0x80, 0x100)]
    meant = [bytes([ord(c)]).decode(codec, "ignore") or c for c in latin]
    pairs = [(a, b) for a, b in zip(latin, meant) if a != b]
    return F.translate(
        F.decode(content, "ISO-8859-1"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    )


def _without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>", "")


def _xml_text(content: Column) -> Column:
    """Bytes to text by byte order mark or declared encoding; null when unreadable."""
    # The whole XML declaration, however long.
    head = F.substring_index(content.cast("string"), "?>", 1)
    declared = F.lower(
        F.regexp_extract(head, "^\\s*<\\?xml[^>]*?encoding\\s*=\\s*[\"']([^\"']*)", 1)
    )
    utf8 = content.cast("string")
    wide = F.startswith(content, F.expr("X'FEFF'")) | F.startswith(content, F.expr("X'FFFE'"))
    text = (
        F.when(wide, F.decode(content, "UTF-16"))
        .when(declared.isin("iso-8859-1", "latin1"), F.decode(content, "ISO-8859-1"))
        .when(declared.isin("", "utf-8", "utf8", "us-ascii", "ascii") & F.is_valid_utf8(utf8), utf8)
    )
    for name, codec in CODE_PAGES.items():
        text = text.when(declared == name, _code_page(content, codec))
    return F.regexp_replace(text, "^\\x{feff}", "")


def _tag_outline(text: Column) -> Column:
    """The nesting of a document, one mark per start tag and one per end tag.

    One pass over the text leaves ``.`` per start tag, ``/.`` per end tag and
    ``>.`` per empty element; text between tags goes with the tag after it.
    """
    body = F.regexp_replace(text, "^\\s*<\\?xml[^>]*\\?>", "")
    bare = F.when(
        body.rlike("<[!?]"),
        F.regexp_replace(body, "(?s)<!--.*?-->|<!\\[CDATA\\[.*?\\]\\]>|<\\?.*?\\?>", ""),
    ).otherwise(body)
    tag = f"[^<]*+<(?:(/)[^<>]*+>|{_ATTRIBUTES}(?<=/)(>)|{_ATTRIBUTES}>)"
    marks = F.regexp_replace(ustrip(bare), tag, "$1$2.")
    for raw, mark in (("/.", _CLOSE), (">.", _OPEN + _CLOSE), (".", _OPEN)):
        marks = F.replace(marks, F.lit(raw), F.lit(mark))
    return marks


def _quick_outline(text: Column) -> Column:
    """The same marks without a pattern scan, for documents without comments,
    CDATA or further instructions: what follows each ``<`` tells the tag kind.

    A ``/>`` inside text or an attribute is taken for an empty element. The
    marks are unbalanced then, and the exact outline is taken instead.
    """
    pieces = F.split(F.regexp_replace(text, "^\\s*<\\?xml[^>]*\\?>", ""), "<")
    marks = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, F.lit(""))
        .when(piece.startswith("/"), F.lit(_CLOSE))
        .when(F.contains(piece, F.lit("/>")), F.lit(_OPEN + _CLOSE))
        .otherwise(F.lit(_OPEN)),
    )
    return F.array_join(marks, "")


def _is_plain(text: Column) -> Column:
    """Ends with an end tag and holds no comment, CDATA or later instruction."""
    last = F.substring_index(text, "<", -1)
    later = F.substring(text, F.lit(10), F.length(text))
    return (
        last.rlike("^/[^<>]*>\\s*\\z")
        & ~F.contains(text, F.lit("<!"))
        & ~F.contains(later, F.lit("<?"))
    )


def _is_single(outline: Column) -> Column:
    return outline.rlike(f"^{_OPEN}[{_OPEN}{_CLOSE}]*{_CLOSE}\\z")


def _strip_levels(outline: Column) -> Column:
    """The outline inside the root with every allowed level taken off.

    Removing every adjacent start/end pair takes one level off all branches at
    once, so whatever is left after as many rounds as levels are allowed below
    the root is either too deep or unbalanced.
    """
    inner = F.substring(outline, F.lit(2), F.length(outline) - 2)
    for _ in range(MAX_XML_DEPTH - 1):
        inner = F.replace(inner, F.lit(_OPEN + _CLOSE), F.lit(""))
    return inner


def _outline_fault(outline: Column, rest: Column) -> Column:
    """Null for one root element nested no deeper than the bound."""
    deep = rest.startswith(_OPEN) & rest.endswith(_CLOSE)
    return (
        F.when(~_is_single(outline), F.lit("not well-formed"))
        .when(rest == "", F.lit(None).cast("string"))
        .when(deep, F.lit(f"exceeds maximum XML nesting depth ({MAX_XML_DEPTH})"))
        .otherwise(F.lit("not well-formed"))
    )


def _foreign_renamed(text: Column) -> Column:
    """The text with the elements of foreign namespaces under names that match nothing.

    The parser matches local names; a prefix that the document binds to another
    vocabulary than the invoice's must not lend its elements to it.
    """
    bound = F.regexp_extract_all(
        text, F.lit("\\sxmlns:([^\\s=]+)\\s*=\\s*(?:\"[^\"]*\"|'[^']*')"), F.lit(0)
    )
    foreign = F.filter(bound, lambda b: ~b.rlike(_INVOICE_SPACES))
    prefixes = F.transform(foreign, lambda b: F.regexp_extract(b, "xmlns:([^\\s=]+)", 1))
    # A prefix with pattern characters is no name an XML parser takes.
    names = F.filter(F.array_distinct(prefixes), lambda p: p.rlike("^[\\w-]+$"))
    pattern = F.concat(F.lit("<(/?)(?:"), F.array_join(names, "|"), F.lit("):"))
    return F.when(F.size(names) > 0, F.regexp_replace(text, pattern, F.lit("<$1foreign_"))).otherwise(text)


def _with_root_tag(rows: DataFrame) -> DataFrame:
    """Adds root_tag: ``{namespace}name``, prefixes resolved on the root."""
    opening = f"(?s)^\\s*(?:<\\?.*?\\?>\\s*|<!--.*?-->\\s*)*(<{_ATTRIBUTES}>)"
    started = rows.withColumn(
        "_start", F.when(F.col("_fault").isNull(), F.regexp_extract("_text", opening, 1))
    )
    start = F.col("_start")
    prefixed = "(?s)^<([^\\s:/>]+):[^\\s/>]+\\s(?:.*?\\s)?xmlns:\\1\\s*=\\s*[\"']([^\"']*)[\"']"
    plain = "(?s)^<[^\\s:/>]+\\s(?:.*?\\s)?xmlns\\s*=\\s*[\"']([^\"']*)[\"']"
    named = started.withColumns(
        {
            "_prefixed": F.regexp_extract(start, prefixed, 2),
            "_plain": F.regexp_extract(start, plain, 1),
            "_name": F.regexp_extract(start, "^<(?:[^\\s:/>]+:)?([^\\s:/>]+)", 1),
        }
    )
    space = F.coalesce(F.nullif(F.col("_prefixed"), F.lit("")), F.nullif(F.col("_plain"), F.lit("")))
    qualified = F.concat(F.coalesce(F.concat(F.lit("{"), space, F.lit("}")), F.lit("")), F.col("_name"))
    return named.withColumn("root_tag", qualified)


def read_xml(documents: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Check and parse a BINARY column of candidate invoice XML.

    Returns ``keep`` plus ``xml_fault`` (null when parsable), ``root_tag``,
    ``n_profiles``, ``profile_id`` and ``x``, what ``map_fields`` maps. Plain
    documents are read in one pass (``xml_leaves``). Of the others, guards run
    from cheap to costly, and a row that fails one is not parsed.
    """
    size = F.length(content)
    quick = read_leaves(F.col(content), QUICK_BYTES, MAX_XML_DEPTH, _SPACE_START)
    read = F.col("_leaves").isNotNull()
    decoded = documents.select(*keep, content, quick.alias("_leaves")).select(
        *keep,
        "_leaves",
        (size > MAX_XML_BYTES).alias("_oversized"),
        F.when(~read & (size <= MAX_XML_BYTES), _xml_text(F.col(content))).alias("_text"),
    )
    text = F.col("_text")
    # One step per select: later steps read a column, not its expression again.
    guarded = decoded.withColumn(
        "_early",
        F.when(read, F.lit(None).cast("string"))
        .when(F.col("_oversized"), F.lit("oversized"))
        .when(text.isNull(), F.lit("unreadable text encoding"))
        .when(
            F.contains(text, F.lit("<!DOCTYPE"))
            & F.contains(_without_comments(text), F.lit("<!DOCTYPE")),
            F.lit("declares a document type"),
        ),
    )
    clean = F.col("_early").isNull() & ~read
    traced = guarded.withColumn("_quick", F.when(clean & _is_plain(text), _quick_outline(text)))
    reduced = traced.withColumn("_quick_rest", _strip_levels(F.col("_quick")))
    sound = F.coalesce(_is_single(F.col("_quick")) & (F.col("_quick_rest") == ""), F.lit(False))
    exact = reduced.withColumn("_outline", F.when(clean & ~sound, _tag_outline(text)))
    peeled = exact.withColumn("_rest", _strip_levels(F.col("_outline")))
    outlined = peeled.withColumn(
        "_fault",
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(
            F.col("_outline").isNotNull(), _outline_fault(F.col("_outline"), F.col("_rest"))
        ),
    )
    parsed = _with_root_tag(
        outlined.withColumn("x", F.when(~read & F.col("_fault").isNull(), F.from_xml(_foreign_renamed(text), _SCHEMA, _OPTIONS)))
    )
    fault = F.coalesce(
        F.col("_fault"), F.when(F.col("x._corrupt_record").isNotNull(), F.lit("not well-formed"))
    )
    told = parsed.select(
        *keep, fault.alias("xml_fault"), "root_tag", F.when(read, F.col("_leaves")).otherwise(_tree_leaves()).alias("x")
    )
    return told.select(
        *keep,
        "xml_fault",
        F.coalesce("x.root_tag", "root_tag").alias("root_tag"),
        F.col("x.n_profiles").alias("n_profiles"),
        F.when(F.col("x.n_profiles") > 0, ustrip(F.coalesce("x.profile", F.lit("")))).alias("profile_id"),
        "x",
    )


def _tree_leaves() -> Column:
    """What ``xml_leaves`` gives, from the parsed tree ``x``."""
    trade = F.col("x.SupplyChainTradeTransaction")
    settlement = _matches(trade, "ApplicableHeaderTradeSettlement")
    profiles = _matches(
        F.col("x.ExchangedDocumentContext"), "GuidelineSpecifiedDocumentContextParameter", "ID"
    )
    dates = _matches(F.col("x.ExchangedDocument"), "IssueDateTime", "DateTimeString")
    texts = {
        "seller": ("n_sellers", _matches(trade, "ApplicableHeaderTradeAgreement", "SellerTradeParty", "Name")),
        "currency": ("n_currencies", _matches(settlement, "InvoiceCurrencyCode")),
        "total": (
            "n_totals",
            _matches(settlement, "SpecifiedTradeSettlementHeaderMonetarySummation", "GrandTotalAmount"),
        ),
    }
    counted = [
        column
        for name, (many, matches) in texts.items()
        for column in (_count(matches).alias(many), _only_text(matches).alias(name))
    ]
    return F.struct(
        F.lit(None).cast("string").alias("root_tag"),
        _count(profiles).alias("n_profiles"),
        F.get(profiles, 0).alias("profile"),
        _count(dates).alias("n_dates"),
        F.when(_count(dates) == 1, F.get(dates, 0)["_VALUE"]).alias("date"),
        F.get(dates, 0)["_format"].alias("date_format"),
        *counted,
        _tree_items(_matches(trade, "IncludedSupplyChainTradeLineItem")).alias("items"),
    )


# ---- field mapping ---------------------------------------------------------


def _tree_items(lines: Column) -> Column:
    """Line elements of the parsed tree to the texts of their single name and total."""
    matched = F.transform(
        lines,
        lambda item: F.struct(
            _matches(item.getField("SpecifiedTradeProduct"), "Name").alias("names"),
            _matches(
                item.getField("SpecifiedLineTradeSettlement"),
                "SpecifiedTradeSettlementLineMonetarySummation",
                "LineTotalAmount",
            ).alias("totals"),
        ),
    )
    return F.transform(
        matched,
        lambda m: F.struct(
            F.when(F.size(m["names"]) == 1, own_text(F.get(m["names"], 0))).alias("name"),
            F.when(F.size(m["totals"]) == 1, own_text(F.get(m["totals"], 0))).alias("total"),
        ),
    )


def _read_items(lines: Column) -> Column:
    """Lines of two texts to (ord, name, amount); unusable values become null.

    Lambdas share no subexpressions, so the work is cut into passes that each
    hand plain fields to the next.
    """
    texts = F.transform(
        lines, lambda t: F.struct(ustrip(t["name"]).alias("name"), ustrip(t["total"]).alias("total"))
    )
    amounts = F.transform(
        texts,
        lambda t: F.struct(
            F.when((t["name"] != "") & (F.length(t["name"]) <= FIELD_TEXT_LIMIT), t["name"]).alias("name"),
            F.when(is_decimal_text(t["total"]), t["total"].try_cast(AMOUNT_TYPE)).alias("amount"),
        ),
    )
    bound = F.lit(AMOUNT_LIMIT).cast(AMOUNT_TYPE)
    return F.transform(
        amounts,
        lambda a, i: F.struct(
            (i + 1).cast("bigint").alias("ord"),
            a["name"].alias("name"),
            F.when((a["amount"] >= 0) & (a["amount"] <= bound), a["amount"]).alias("amount"),
        ),
    )


def _rejected(field: str, reason: str, shown: Column | None = None, tail: str = "") -> Column:
    if shown is None:
        return F.lit(f"{field}: {reason}{_FALLBACK}")
    return F.concat(
        F.lit(f"{field}: {reason} "), quoted_echo(bounded_echo(shown, 50)), F.lit(tail + _FALLBACK)
    )


def map_fields(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The texts ``x`` of ``read_xml`` to validated fields; each field stands alone.

    Returns ``keep`` plus the five fields, ``items``, ``evidence`` (paths of
    the fields found) and ``warnings`` in field order.
    """
    only = lambda name: F.nullif(ustrip(F.col(f"x.{name}")), F.lit(""))
    counts = {"_dates": "n_dates", "_sellers": "n_sellers", "_currencies": "n_currencies", "_totals": "n_totals"}
    raw = parsed.select(
        *keep,
        _read_items(F.col("x.items")).alias("items"),
        *[(F.col(f"x.{n}") > 1).alias(f"{c}_repeated") for c, n in counts.items()],
        only("date").alias("_date"),
        F.col("x.date_format").alias("_date_format"),
        only("seller").alias("_seller"),
        only("currency").alias("_currency"),
        only("total").alias("_total"),
    )
    texts = raw.select("*", rank_array(F.col("items")).alias("_ranked"))
    known_format = F.coalesce(F.col("_date_format") == DATE_FORMAT_CODE, F.lit(False))
    valued = texts.select(
        "*",
        F.when(~too_long(F.col("_date")) & known_format, compact_date(F.col("_date"))).alias(
            "invoice_date"
        ),
        bounded_value(F.col("_seller")).alias("seller"),
        bounded_decimal(F.col("_total")).alias("_amount"),
        F.when(is_currency(F.col("_currency")), F.col("_currency")).alias("currency"),
        *[c.alias(a) for c, a in zip(summary_of_ranked(F.col("_ranked")), ("product_summary", "_product_warning"))],
    )
    repeated = lambda c: F.col(f"{c}_repeated")
    warnings = F.array_compact(
        F.array(
            F.when(repeated("_dates"), _rejected("invoice_date", "multiple conflicting XML issue dates"))
            .when(too_long(F.col("_date")), bounded_warning(F.col("_date"), "invoice_date"))
            .when(F.col("_date").isNull(), None)
            .when(~known_format, _rejected("invoice_date", "unsupported XML date format", F.col("_date_format")))
            .when(F.col("invoice_date").isNull(), _rejected("invoice_date", "unparseable XML date", F.col("_date"))),
            F.when(repeated("_sellers"), _rejected("seller", "multiple conflicting XML seller names"))
            .otherwise(bounded_warning(F.col("_seller"), "seller")),
            F.col("_product_warning"),
            F.when(repeated("_totals"), _rejected("gross_total", "multiple conflicting XML grand totals"))
            .when(F.col("_total").isNull(), None)
            .when(
                F.col("_amount").isNull(),
                _rejected("gross_total", "invalid or out-of-range XML amount", F.col("_total")),
            )
            .when(F.col("_amount") < 0, _rejected("gross_total", "XML grand total", F.col("_total"), " is negative")),
            F.when(repeated("_currencies"), _rejected("currency", "multiple conflicting XML currency codes"))
            .when(too_long(F.col("_currency")), bounded_warning(F.col("_currency"), "currency"))
            .when(
                F.col("_currency").isNotNull() & F.col("currency").isNull(),
                _rejected("currency", "invalid XML currency code", F.col("_currency")),
            ),
        )
    )
    fields = valued.select(
        *keep,
        "invoice_date",
        "seller",
        "product_summary",
        F.when(F.col("_amount") >= 0, F.col("_amount")).alias("gross_total"),
        "currency",
        "items",
        warnings.alias("warnings"),
    )
    return fields.withColumn("evidence", evidence_map())


def evidence_map() -> Column:
    """Paths of the fields that hold a value, as a map of evidence structs."""
    entries = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    F.lit(None).cast("int").alias("page"),
                    F.lit(None).cast("string").alias("excerpt"),
                    F.lit(path).alias("xml_field"),
                ).alias("value"),
            ),
        )
        for name, path in FIELD_PATHS.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries)))
