"""Queries over job events: the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.catalog.registry import query
from fieldloom.catalog.views import oracle, spark_view
from fieldloom.operators import jobs


def events(spark, sf_dir):
    return spark_view(spark, sf_dir, "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))


def job_table(spark, sf_dir):
    return jobs.lifecycle(events(spark, sf_dir))


# Each job's events replayed one by one through the state table.
LIFECYCLE_SQL = """
e as (select *, row_number() over (partition by item_id, generation order by ts, seq) n from v_jobs where generation>0),
fold as (
  select item_id, generation, n, batch_id, bytes, case when status='queued' then 'queued' end state, false asked,
    case when status='queued' then ts end queued_ts, cast(null as timestamp) ended_ts from e where n=1
  union all
  select e.item_id, e.generation, e.n, case when f.state is null then e.batch_id else f.batch_id end, case when f.state is null then e.bytes else f.bytes end,
    case when f.state is null then case when e.status='queued' then 'queued' end
         when f.state='queued' then case e.status when 'running' then 'running' when 'cancel_requested' then 'cancelled' else 'queued' end
         when f.state='running' then case e.status when 'failed' then 'failed' when 'completed' then case when f.asked then 'cancelled' else 'completed' end else 'running' end
         else f.state end,
    f.asked or (f.state='running' and e.status='cancel_requested'),
    coalesce(f.queued_ts, case when e.status='queued' then e.ts end),
    coalesce(f.ended_ts, case when (f.state='queued' and e.status='cancel_requested') or (f.state='running' and e.status in ('failed','completed')) then e.ts end)
  from fold f join e on e.item_id=f.item_id and e.generation=f.generation and e.n=f.n+1),
jobs as (select * from (select *, row_number() over (partition by item_id, generation order by n desc) r from fold) where r=1 and state is not null)"""


def recursive(body: str, *views: str) -> str:
    return oracle(body, *views).replace("with ", "with recursive ", 1)


@query(
    "st2_job_lifecycle",
    "ST-2",
    recursive(
        f""", {LIFECYCLE_SQL}
select item_id, cast(generation as bigint) generation, state status, asked cancel_requested, epoch_us(queued_ts) queued_us, epoch_us(ended_ts) ended_us from jobs""",
        "v_jobs",
    ),
)
def job_lifecycle(spark, sf_dir):
    return job_table(spark, sf_dir).select(
        "item_id",
        "generation",
        "status",
        "cancel_requested",
        F.unix_micros("queued_ts").alias("queued_us"),
        F.unix_micros("ended_ts").alias("ended_us"),
    )


@query(
    "win4_newest_generation",
    "WIN-4",
    oracle(
        """, ranked as (select *, row_number() over (partition by item_id order by generation desc, ts desc, seq desc) r from v_jobs)
select item_id, cast(generation as bigint) generation, status from ranked where r=1""",
        "v_jobs",
    ),
)
def newest_generation(spark, sf_dir):
    return jobs.newest_generation(events(spark, sf_dir))


@query(
    "st3_stale_responses",
    "ST-3",
    oracle(
        """, late as (select item_id, seq, cast(generation as bigint)-case when seq%4=0 then 1 else 0 end generation from v_jobs)
select item_id, seq, generation, coalesce(max(generation) over (partition by item_id order by seq rows between unbounded preceding and 1 preceding)>generation, false) stale from late""",
        "v_jobs",
    ),
)
def stale_responses(spark, sf_dir):
    late = events(spark, sf_dir).selectExpr(
        "item_id", "seq", "generation - case when seq%4=0 then 1 else 0 end generation"
    )
    return jobs.mark_stale(late, "seq")


@query(
    "st4_settled_batches",
    "ST-4",
    recursive(
        f""", {LIFECYCLE_SQL}
select batch_id, count(*) jobs, count(*) filter (where state in ('completed','failed','cancelled')) ended,
  bool_and(state in ('completed','failed','cancelled')) settled,
  case when bool_and(state in ('completed','failed','cancelled')) then epoch_us(max(ended_ts)) end settled_us from jobs group by 1""",
        "v_jobs",
    ),
)
def settled_batches(spark, sf_dir):
    return jobs.settled_batches(job_table(spark, sf_dir)).select(
        "batch_id", "jobs", "ended", "settled", F.unix_micros("settled_ts").alias("settled_us")
    )


_ISLANDS = """flagged as (select *, case when start_us - max(end_or_max) over (partition by batch_id order by start_us, end_or_max rows between unbounded preceding and 1 preceding) < 300000000 then 0 else 1 end opens from spans),
islands as (select *, sum(opens) over (partition by batch_id order by start_us, end_or_max rows unbounded preceding) island from flagged)
select batch_id, min(start_us) start_us, nullif(max(end_or_max), 2305843009213693952) end_us, count(*) n from islands group by batch_id, island"""


@query(
    "st5_residency_sessions",
    "ST-5",
    oracle(
        f", spans as (select batch_id, epoch_us(ts) start_us, epoch_us(ts) end_or_max from v_jobs), {_ISLANDS}", "v_jobs"
    ),
)
def residency_sessions(spark, sf_dir):
    return jobs.event_sessions(events(spark, sf_dir), ["batch_id"])


@query(
    "st5_residency_of_jobs",
    "ST-5",
    recursive(
        f""", {LIFECYCLE_SQL},
spans as (select item_id batch_id, epoch_us(queued_ts) start_us, coalesce(epoch_us(ended_ts), 2305843009213693952) end_or_max from jobs), {_ISLANDS}""",
        "v_jobs",
    ),
)
def residency_of_jobs(spark, sf_dir):
    return jobs.residency(job_table(spark, sf_dir), ["item_id"]).withColumnRenamed("item_id", "batch_id")


ADMISSION_SQL = recursive(
    f""", {LIFECYCLE_SQL},
moves as (select batch_id, item_id, generation, bytes, queued_ts at_ts, bytes delta from jobs
  union all select batch_id, item_id, generation, bytes, ended_ts, -bytes from jobs where ended_ts is not null),
queue as (select *, row_number() over (partition by batch_id order by at_ts, delta, item_id, generation) n from moves),
walk as (
  select batch_id, cast(0 as bigint) n, cast(null as bigint) item_id, cast(null as bigint) generation, cast(0 as bigint) pending,
    cast([] as varchar[]) refused, cast(null as boolean) accepted from (select distinct batch_id from jobs)
  union all
  select q.batch_id, q.n, q.item_id, cast(q.generation as bigint),
    case when q.delta<0 then case when list_contains(w.refused, q.item_id||'/'||q.generation) then w.pending else w.pending+q.delta end
         when w.pending+q.bytes>524288000 then w.pending else w.pending+q.bytes end,
    case when q.delta>=0 and w.pending+q.bytes>524288000 then list_append(w.refused, q.item_id||'/'||q.generation) else w.refused end,
    case when q.delta>=0 then w.pending+q.bytes<=524288000 end
  from walk w join queue q on q.batch_id=w.batch_id and q.n=w.n+1)
select batch_id, item_id, generation, accepted from walk where accepted is not null""",
    "v_jobs",
)


@query("st6_admission_cap", "ST-6", ADMISSION_SQL)
def admission_cap(spark, sf_dir):
    return jobs.admit_jobs(job_table(spark, sf_dir))


@query(
    "st7_live_counters",
    "ST-7",
    recursive(
        f""", {LIFECYCLE_SQL},
newest as (select batch_id, item_id, arg_max(state, generation) state from jobs group by 1, 2)
select batch_id, count(*) total, count(*) filter (where state='completed') done, count(*) filter (where state in ('queued','running')) queued,
  count(*) filter (where state in ('failed','cancelled')) failed from newest group by 1""",
        "v_jobs",
    ),
)
def live_counters(spark, sf_dir):
    return jobs.live_counters(job_table(spark, sf_dir))
