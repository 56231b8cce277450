"""Which embedded invoice XML, if any, a document can be read from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import quoted_echo
from fieldloom.operators import invoice_xml
from fieldloom.operators.invoice_xml import MAX_XML_BYTES, ROOT_NAME, ROOT_NAMESPACE, SUPPORTED_PROFILE

# Attachment names looked at, and the bounds on how many.
KNOWN_NAMES = ("zugferd-invoice.xml", "factur-x.xml", "xrechnung.xml")
MAX_KNOWN_NAMES = 10
MAX_REVISIONS = 5

FIELD_COLUMNS = (
    "invoice_date",
    "seller",
    "product_summary",
    "gross_total",
    "currency",
    "evidence",
    "warnings",
)


def is_known_name(name: Column) -> Column:
    return F.lower(name).isin(*KNOWN_NAMES)


def known_attachments(attachments: DataFrame) -> DataFrame:
    return attachments.filter(is_known_name(F.col("attachment_name")))


def name_counts(attachments: DataFrame, order: str = "revision_no") -> DataFrame:
    """Per document: distinct known names, and the first name with too many revisions.

    Reads names only; the bytes are not touched. Empty revisions count.
    """
    per_name = (
        known_attachments(attachments)
        .groupBy("doc_id", "attachment_name")
        .agg(F.count(F.lit(1)).alias("revisions"), F.min(order).alias("seen"))
    )
    crowded = F.col("revisions") > MAX_REVISIONS
    first = F.min(F.when(crowded, F.struct("seen", "attachment_name", "revisions")))
    return per_name.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_names"),
        F.max("revisions").alias("max_revisions"),
        first.alias("crowded"),
    )


def distinct_contents(facts: DataFrame, order: str = "revision_no") -> DataFrame:
    """Per document: how many different contents, the first one, and their names.

    Equal contents are merged by (document, hash) before the document level,
    so copies collapse in the map-side combine and one document with very
    many attachments is spread over all tasks.
    """
    carried = [c for c in facts.columns if c not in ("doc_id", "content_hash")]
    per_content = facts.groupBy("doc_id", "content_hash").agg(
        F.min(F.struct(order, "attachment_name")).alias("first"),
        F.min_by(F.struct(*carried), F.struct(order, "attachment_name")).alias("facts"),
    )
    return per_content.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_contents"),
        F.min_by("facts", "first").alias("facts"),
        F.array_join(
            F.array_sort(F.collect_set(F.col("first.attachment_name"))), ", "
        ).alias("content_names"),
    )


def attachment_facts(attachments: DataFrame, order: str = "revision_no") -> DataFrame:
    """Checked and mapped XML per non-empty known attachment, as narrow rows."""
    keep = ["doc_id", "attachment_name", order, "content_hash"]
    candidates = (
        known_attachments(attachments)
        .filter(F.length("content") > 0)
        .withColumn("content_hash", F.sha2("content", 256))
    )
    checked = invoice_xml.read_xml(candidates, "content", keep)
    checks = ["xml_fault", "root_tag", "n_profiles", "profile_id"]
    return invoice_xml.map_fields(checked, keep + checks).select(*keep, *checks, *FIELD_COLUMNS)


ROOT_TAG = f"{{{ROOT_NAMESPACE}}}{ROOT_NAME}"


def content_cases(fact, shown: Column) -> list[tuple]:
    """(condition, status, warning) for one attachment's content; none holds if it is supported.

    ``fact`` gives xml_fault, root_tag, n_profiles and profile_id by name.
    """
    # The texts of the messages below are results that must come out the same.
    return [
        (
            fact("xml_fault") == "oversized",
            "invalid",
            F.concat(shown, F.lit(f" exceeds the {MAX_XML_BYTES}-byte limit for invoice XML")),
        ),
        (
            fact("xml_fault").isNotNull(),
            "invalid",
            F.concat(shown, F.lit(" is not valid XML: "), fact("xml_fault")),
        ),
        (
            fact("root_tag") != ROOT_TAG,
            "unsupported",
            F.concat(shown, F.lit(" has an unsupported root element "), quoted_echo(fact("root_tag"))),
        ),
        (
            fact("n_profiles") > 1,
            "invalid",
            F.concat(shown, F.lit(" declares more than one conflicting invoice profile")),
        ),
        (
            F.coalesce(fact("profile_id"), F.lit("")) != SUPPORTED_PROFILE,
            "unsupported",
            F.concat(
                shown, F.lit(" uses an unsupported invoice profile "), quoted_echo(fact("profile_id"))
            ),
        ),
    ]


def first_case(cases: list[tuple]) -> tuple[Column, Column]:
    """Status and warning of the first case that holds; "supported" and null if none does."""
    status = warning = None
    for condition, name, text in cases:
        status = F.when(condition, F.lit(name)) if status is None else status.when(condition, F.lit(name))
        warning = F.when(condition, text) if warning is None else warning.when(condition, text)
    return status.otherwise(F.lit("supported")), warning


def classify(counted: DataFrame, *kept: str) -> DataFrame:
    """The decision per document from its counts and its first content; ``kept`` columns stay."""
    fact = lambda name: F.col(f"facts.{name}")
    shown = quoted_echo(fact("attachment_name"))
    no_text = F.lit(None).cast("string")
    # The texts of the messages below are results that must come out the same.
    broken = fact("xml_fault").isNotNull()
    cases = [
        (F.col("n_names").isNull(), "none", no_text),
        (
            F.col("n_names") > MAX_KNOWN_NAMES,
            "ambiguous",
            F.format_string(
                "found %d distinctly-named invoice XML attachments, more than can be safely "
                "checked for conflicts; skipping XML extraction",
                "n_names",
            ),
        ),
        (
            F.col("crowded").isNotNull(),
            "ambiguous",
            F.concat(
                quoted_echo(F.col("crowded.attachment_name")),
                F.format_string(
                    " has %d attachment revisions, more than can be safely checked for "
                    "conflicts; skipping XML extraction",
                    F.col("crowded.revisions"),
                ),
            ),
        ),
        (F.col("n_contents").isNull(), "none", no_text),
        (
            F.col("n_contents") > 1,
            "ambiguous",
            F.concat(
                F.lit("multiple distinct invoice XML attachments found ("),
                F.col("content_names"),
                F.lit("); skipping XML extraction"),
            ),
        ),
        *content_cases(fact, shown),
    ]
    status, warning = first_case(cases)
    decided = counted.withColumns({"xml_status": status, "xml_warning": warning})
    single = F.col("xml_status").isin("supported", "unsupported", "invalid")
    # The profile is known once the root and its single profile were accepted.
    profiled = single & ~broken & (fact("root_tag") == ROOT_TAG) & (fact("n_profiles") <= 1)
    return decided.select(
        "doc_id",
        *kept,
        "xml_status",
        F.when(single, fact("attachment_name")).alias("xml_attachment_name"),
        F.when(profiled, fact("profile_id")).alias("xml_profile_id"),
        "xml_warning",
        F.when(F.col("xml_status") == "supported", F.col("facts")).alias("facts"),
    )


def count_attachments(documents: DataFrame, attachments: DataFrame, order: str = "revision_no") -> DataFrame:
    """``documents`` with the counts of their attachments and the first content."""
    counts = name_counts(attachments, order)
    contents = distinct_contents(attachment_facts(attachments, order), order)
    return documents.join(counts, "doc_id", "left").join(contents, "doc_id", "left")


def discover_xml(
    documents: DataFrame, attachments: DataFrame, order: str = "revision_no"
) -> DataFrame:
    """One row per document: status, attachment, profile, warning and, for a
    supported attachment, the mapped fields in ``facts``."""
    return classify(count_attachments(documents.select("doc_id"), attachments, order))
