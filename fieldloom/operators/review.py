"""Review items: display names, status, actions and batch counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The item status shown for each job status.
ITEM_STATUS = {
    "queued": "queued",
    "running": "running",
    "completed": "needs_review",
    "failed": "failed",
    "cancelled": "cancelled",
}
PAYLOAD_COLUMNS = ("content", "document_bytes", "bytes")


def display_name(edited: Column, proposed: Column, original: Column) -> Column:
    return F.coalesce(edited, proposed, original)


def item_status(job_status: Column) -> Column:
    pairs = [F.lit(part) for item in ITEM_STATUS.items() for part in item]
    return F.element_at(F.create_map(*pairs), job_status)


def public_view(jobs: DataFrame) -> DataFrame:
    """Everything but the payload, projected before anything is shuffled."""
    return jobs.drop(*PAYLOAD_COLUMNS)


def has_warnings(n_warnings: Column, missing: Column) -> Column:
    return F.coalesce((n_warnings > 0) | missing, F.lit(False))


def has_issue(status: Column, warned: Column) -> Column:
    return status.isin("failed", "cancelled") | ((status == "needs_review") & warned)


def apply_actions(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Applies the review log: (item_id, seq, action, filename) rows.

    The latest status action and the latest edit of an item stand. Folding
    the log with ``max_by`` combines map-side, so an item with a very long
    log costs one row per task. ``approve_all`` rows carry no item: they
    approve every item waiting for review.
    """
    status_action = F.col("action").isin("approve", "unapprove")
    latest = actions.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.max_by(F.when(status_action, F.col("action")), F.when(status_action, F.col("seq"))).alias("last_action"),
        F.max(F.when(status_action, F.col("seq"))).alias("last_seq"),
        F.max_by(
            F.when(F.col("action") == "edit", F.col("filename")),
            F.when(F.col("action") == "edit", F.col("seq")),
        ).alias("last_edit"),
    )
    approve_all = actions.filter(F.col("action") == "approve_all").agg(F.max("seq"))
    joined = items.join(latest, "item_id", "left").withColumn("all_seq", approve_all.scalar())
    own = F.when(F.col("last_action") == "approve", F.lit("approved")).when(
        F.col("last_action") == "unapprove", F.lit("needs_review")
    )
    acted = F.coalesce(own, F.col("status"))
    later = F.coalesce(F.col("all_seq") > F.coalesce(F.col("last_seq"), F.lit(-1)), F.lit(False))
    return joined.withColumns(
        {
            "status": F.when(later & (acted == "needs_review"), F.lit("approved")).otherwise(acted),
            "edited": F.coalesce("last_edit", "edited"),
        }
    ).drop("last_action", "last_seq", "last_edit", "all_seq")


def progress_counts(items: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """done / queued / warnings / failed / total per batch, with a summary line."""
    status, warned = F.col("status"), has_warnings(F.col("n_warnings"), F.col("missing"))
    review = status == "needs_review"
    counts = items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((status == "approved") | (review & ~warned)).alias("done"),
        F.count_if(status.isin("pending", "queued", "running")).alias("queued"),
        F.count_if(review & warned).alias("warnings"),
        F.count_if(status.isin("failed", "cancelled")).alias("failed"),
    )
    return counts.withColumn("summary", progress_summary())


def progress_summary() -> Column:
    part = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" "), word))
    plural = F.when(F.col("warnings") == 1, F.lit("warning")).otherwise(F.lit("warnings"))
    return F.concat_ws(
        " · ",
        F.concat(F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" done")),
        part("queued", F.lit("queued")),
        part("warnings", plural),
        part("failed", F.lit("failed")),
    )


def workspace_counters(items: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    status = F.col("status")
    warned = has_warnings(F.col("n_warnings"), F.col("missing"))
    return items.groupBy(*keys).agg(
        F.bool_or(status.isin("queued", "running")).alias("analyzing"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status == "approved").alias("approved"),
        F.count_if(status == "needs_review").alias("needs_review"),
        F.count_if((status == "approved") & ~F.coalesce("renamed", F.lit(False))).alias("renameable"),
        F.count_if(has_issue(status, warned)).alias("issues"),
    )


def eligible_items(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Approved items that have not been renamed yet."""
    renamed = outcomes.filter(F.col("outcome") == "renamed").select(
        F.col("request_id").alias("item_id")
    )
    return items.filter(F.col("status") == "approved").join(renamed, "item_id", "left_anti")
