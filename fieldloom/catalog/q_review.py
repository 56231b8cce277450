"""Queries over review items: names, status, actions, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.operators import review


def items(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_items")


@query("prj1_display_names", "PRJ-1", oracle("select item_id, coalesce(edited, proposed, file_name) shown from v_items", "v_items"))
def display_names(spark, sf_dir):
    shown = review.display_name(F.col("edited"), F.col("proposed"), F.col("file_name"))
    return items(spark, sf_dir).select("item_id", shown.alias("shown"))


@query(
    "prj2_status_mapping",
    "PRJ-2",
    oracle(
        """select item_id, seq, case status when 'completed' then 'needs_review' when 'cancel_requested' then null else status end item_status from v_jobs""",
        "v_jobs",
    ),
)
def status_mapping(spark, sf_dir):
    jobs = spark_view(spark, sf_dir, "v_jobs")
    return jobs.select("item_id", "seq", review.item_status(F.col("status")).alias("item_status"))


@query("prj3_public_view", "PRJ-3", oracle("select item_id, seq, batch_id, status from v_jobs", "v_jobs"))
def public_view(spark, sf_dir):
    jobs = spark_view(spark, sf_dir, "v_jobs")
    return review.public_view(jobs).select("item_id", "seq", "batch_id", "status")


_WARNED = "(n_warnings>0 or missing)"
_ISSUE = f"(status in ('failed','cancelled') or (status='needs_review' and {_WARNED}))"


@query("flt6_item_issues", "FLT-6", oracle(f"select item_id, {_WARNED} warned, {_ISSUE} issue from v_items", "v_items"))
def item_issues(spark, sf_dir):
    warned = review.has_warnings(F.col("n_warnings"), F.col("missing"))
    flagged = items(spark, sf_dir).withColumn("warned", warned)
    return flagged.select(
        "item_id", "warned", review.has_issue(F.col("status"), F.col("warned")).alias("issue")
    )


# Two log entries per item, in a fixed order, and one approve-all in between.
_LOG_SQL = """review_log as (
  select item_id, item_id%7 seq, case item_id%3 when 0 then 'approve' when 1 then 'unapprove' else 'edit' end action,
    case when item_id%3=2 then 'edit'||cast(item_id as {text})||'.pdf' end filename from v_items
  union all
  select item_id, 7+item_id%5, case item_id%4 when 0 then 'unapprove' when 1 then 'approve' else 'edit' end,
    case when item_id%4>1 then 'late'||cast(item_id as {text})||'.pdf' end from v_items
  union all select distinct null, 5, 'approve_all', null from v_items)"""


@query(
    "prj6_review_actions",
    "PRJ-6",
    oracle(
        f""", {_LOG_SQL.format(text='varchar')},
latest as (select item_id, arg_max(action, seq) filter (where action in ('approve','unapprove')) act,
   max(seq) filter (where action in ('approve','unapprove')) act_seq,
   arg_max(filename, seq) filter (where action='edit') edit from review_log where item_id is not null group by 1),
acted as (select v.*, edit, act_seq, case act when 'approve' then 'approved' when 'unapprove' then 'needs_review' else status end s
   from v_items v left join latest using (item_id))
select item_id, case when s='needs_review' and 5>coalesce(act_seq,-1) then 'approved' else s end status, coalesce(edit, edited) edited from acted""",
        "v_items",
    ),
)
def review_actions(spark, sf_dir):
    view = items(spark, sf_dir)
    log = spark.sql(
        "with " + _LOG_SQL.format(text="string").replace("v_items", "{v_items}") + " select * from review_log",
        v_items=view,
    )
    return review.apply_actions(view, log).select("item_id", "status", "edited")


_COUNTS = f"""count(*) total, count(*) filter (where status='approved' or (status='needs_review' and not {_WARNED})) done,
 count(*) filter (where status in ('pending','queued','running')) queued,
 count(*) filter (where status='needs_review' and {_WARNED}) warnings, count(*) filter (where status in ('failed','cancelled')) failed"""
SUMMARY_SQL = """concat_ws(' · ', done||'/'||total||' done', case when queued>0 then queued||' queued' end,
 case when warnings>0 then warnings||case when warnings=1 then ' warning' else ' warnings' end end, case when failed>0 then failed||' failed' end)"""


@query(
    "agg8_batch_progress",
    "AGG-8",
    oracle(f", c as (select batch_id, {_COUNTS} from v_items group by 1) select *, {SUMMARY_SQL} summary from c", "v_items"),
)
def batch_progress(spark, sf_dir):
    return review.progress_counts(items(spark, sf_dir))


@query(
    "agg9_workspace_counters",
    "AGG-9",
    oracle(
        f"""select batch_id, bool_or(status in ('queued','running')) analyzing, count(*) filter (where status='pending') pending,
 count(*) filter (where status='approved') approved, count(*) filter (where status='needs_review') needs_review,
 count(*) filter (where status='approved' and not renamed) renameable, count(*) filter (where {_ISSUE}) issues from v_items group by 1""",
        "v_items",
    ),
)
def workspace_counters(spark, sf_dir):
    return review.workspace_counters(items(spark, sf_dir))


@query(
    "join3_eligible_items",
    "JOIN-3",
    oracle("select item_id, coalesce(edited, proposed, file_name) desired from v_items where status='approved' and not renamed", "v_items"),
)
def eligible_items(spark, sf_dir):
    view = items(spark, sf_dir)
    outcomes = view.select(
        F.col("item_id").alias("request_id"),
        F.when(F.col("renamed"), F.lit("renamed")).otherwise(F.lit("failed")).alias("outcome"),
    )
    shown = review.display_name(F.col("edited"), F.col("proposed"), F.col("file_name"))
    return review.eligible_items(view, outcomes).select("item_id", shown.alias("desired"))
