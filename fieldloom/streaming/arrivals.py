"""Arriving documents to proposals, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.text import quoted_echo
from fieldloom.operators import attachments, invoice_xml, merge, naming


def xml_proposals(documents: DataFrame) -> DataFrame:
    """(doc_id, content, attachment_name) of invoice XML to proposals; works on
    streams and tables, one attachment for each document.

    Checking, mapping and naming are projections, so the stream needs no state
    and each file is read once. Documents pass the same checks as in
    ``attachments.discover_xml``: only a supported one lends its fields.
    Attachments of other names give no row; without the column every row counts
    as ``invoice.xml``.
    """
    if "attachment_name" in documents.columns:
        rows = attachments.known_attachments(documents)
    else:
        rows = documents.withColumn("attachment_name", F.lit("invoice.xml"))
    keep = ["doc_id", "attachment_name"]
    checks = ["xml_fault", "root_tag", "n_profiles", "profile_id"]
    checked = invoice_xml.read_xml(rows, "content", keep)
    mapped = invoice_xml.map_fields(checked, keep + checks)
    status, warning = attachments.first_case(
        attachments.content_cases(F.col, quoted_echo(F.col("attachment_name")))
    )
    judged = mapped.withColumns({"xml_status": status, "xml_warning": warning})
    supported = F.col("xml_status") == "supported"
    fields = [c for c in mapped.columns if c not in keep + checks]
    named = naming.propose_filenames(judged.withColumns({c: F.when(supported, F.col(c)) for c in fields}))
    return named.select(
        "doc_id",
        F.col("xml_fault"),
        "xml_status",
        "xml_warning",
        "proposed_filename",
        "missing_fields",
        "requires_review",
        merge.fields_used(F.col).alias("xml_fields_used"),
    )


def write_proposals(proposals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends finished proposals; a restart continues after the last file."""
    return (
        proposals.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_per_batch(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``handle(batch, batch_id)``, e.g. the whole
    analysis joined with the calls made so far."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
