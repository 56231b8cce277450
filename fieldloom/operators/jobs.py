"""Job events: lifecycle, generations, batches, residency, admission.

These are the batch forms; the streaming forms keep the same state per key.
A job's fate depends on which of a few events came first, so it is found with
minima, which combine map-side, instead of replaying a job's events in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.ordered import STRETCH, running_max, running_total, running_totals
from fieldloom.session import cut_lineage

JOB = ["item_id", "generation"]
TERMINAL = ("completed", "failed", "cancelled", "rejected")

# Idle time before the loaded model is dropped, pending-byte cap.
IDLE_MICROS = 5 * 60 * 1_000_000
MAX_PENDING_BYTES = 500 * 1024 * 1024


def moment() -> Column:
    return F.struct("ts", "seq")


def _first(status: str, after: Column | None = None) -> Column:
    hit = F.col("status") == status
    return F.min(F.when(hit if after is None else hit & (moment() > after), moment()))


def lifecycle(events: DataFrame) -> DataFrame:
    """(item, generation, status, cancel_requested, started, ended, bytes) per job.

    Cancelling a queued job ends it at once. Cancelling a running one only
    marks it: it becomes cancelled when it completes, and stays failed when
    it fails. After its end a job changes no more.
    """
    queued = F.col("status") == "queued"
    submitted = events.groupBy(*JOB).agg(
        _first("queued").alias("queued_at"),
        F.min_by(F.when(queued, F.struct("batch_id", "bytes")), F.when(queued, moment())).alias("job"),
    ).filter(F.col("queued_at").isNotNull())
    started = (
        events.join(submitted, JOB)
        .groupBy(*JOB)
        .agg(
            F.first("queued_at").alias("queued_at"),
            F.first("job").alias("job"),
            _first("running", F.col("queued_at")).alias("running_at"),
            _first("cancel_requested", F.col("queued_at")).alias("cancel_at"),
        )
    )
    # A cancel before the start leaves nothing to run.
    withdrawn = F.col("cancel_at").isNotNull() & (
        F.col("running_at").isNull() | (F.col("cancel_at") < F.col("running_at"))
    )
    ends = (
        events.join(started.select(*JOB, "running_at"), JOB)
        .groupBy(*JOB)
        .agg(
            _first("completed", F.col("running_at")).alias("completed_at"),
            _first("failed", F.col("running_at")).alias("failed_at"),
        )
    )
    known = started.join(ends, JOB)
    completed, failed = F.col("completed_at"), F.col("failed_at")
    ended_at = F.least(completed, failed)
    cancelled_late = F.col("cancel_at").isNotNull() & (F.col("cancel_at") < ended_at)
    status = (
        F.when(withdrawn, F.lit("cancelled"))
        .when(F.col("running_at").isNull(), F.lit("queued"))
        .when(ended_at.isNull(), F.lit("running"))
        .when(ended_at == failed, F.lit("failed"))
        .when(cancelled_late, F.lit("cancelled"))
        .otherwise(F.lit("completed"))
    )
    ended = F.when(withdrawn, F.col("cancel_at")).otherwise(ended_at)
    return known.select(
        *JOB,
        "job.batch_id",
        "job.bytes",
        status.alias("status"),
        F.coalesce(
            ~withdrawn & F.col("cancel_at").isNotNull() & (ended_at.isNull() | cancelled_late),
            F.lit(False),
        ).alias("cancel_requested"),
        F.col("queued_at.ts").alias("queued_ts"),
        ended["ts"].alias("ended_ts"),
    )


def newest_generation(events: DataFrame) -> DataFrame:
    """The state each item shows: the latest event of its newest generation."""
    order = F.struct("generation", "ts", "seq")
    return events.groupBy("item_id").agg(
        F.max("generation").alias("generation"), F.max_by("status", order).alias("status")
    )


def mark_stale(responses: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Adds ``stale``: a newer generation of the item had already been seen."""
    seen = running_max(responses, ["item_id"], arrival, "generation", "_seen")
    return seen.withColumn(
        "stale", F.coalesce(F.col("_seen") > F.col("generation"), F.lit(False))
    ).drop("_seen")


def settled_batches(jobs: DataFrame) -> DataFrame:
    """Per batch: whether every submitted job has ended, and since when."""
    ended = F.col("status").isin(*TERMINAL)
    counts = jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(ended).alias("ended"),
        F.max("ended_ts").alias("last_end"),
    )
    settled = F.col("jobs") == F.col("ended")
    return counts.select(
        "batch_id", "jobs", "ended", settled.alias("settled"), F.when(settled, F.col("last_end")).alias("settled_ts")
    )


def live_counters(jobs: DataFrame) -> DataFrame:
    """Progress per batch over each item's newest job."""
    newest = jobs.groupBy("batch_id", "item_id").agg(F.max_by("status", "generation").alias("status"))
    status = F.col("status")
    return newest.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "completed").alias("done"),
        F.count_if(status.isin("queued", "running")).alias("queued"),
        F.count_if(status.isin("failed", "cancelled", "rejected")).alias("failed"),
    )


def sessions(intervals: DataFrame, keys: list[str], idle: int = IDLE_MICROS, stretch: int = STRETCH) -> DataFrame:
    """Merges (start_us, end_us) intervals less than ``idle`` apart.

    An interval opens a session when everything before it ended at least
    ``idle`` earlier. Both passes run over stretches of rows, so one busy key
    is not replayed in one task. A null end keeps the session open.
    """
    forever = F.lit(1 << 61).cast("bigint")
    closed = intervals.withColumn("_end", F.coalesce("end_us", forever))
    behind = running_max(closed, keys, "start_us", "_end", "_reach", ("_end",), stretch)
    opens = F.coalesce(F.col("start_us") - F.col("_reach") >= idle, F.lit(True)).cast("int")
    flagged = behind.withColumn("_opens", opens)
    counted = running_total(flagged, keys, "start_us", "_opens", "_before", ("_end",), stretch)
    grouped = counted.withColumn("_session", F.col("_before") + F.col("_opens"))
    merged = grouped.groupBy(*keys, "_session").agg(
        F.min("start_us").alias("start_us"), F.max("_end").alias("_end"), F.count(F.lit(1)).alias("n")
    )
    return merged.select(
        *keys, "start_us", F.when(F.col("_end") < forever, F.col("_end")).alias("end_us"), "n"
    )


def event_sessions(events: DataFrame, keys: list[str], idle: int = IDLE_MICROS) -> DataFrame:
    """Sessions of point events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    points = events.select(*keys, micros.alias("start_us"), micros.alias("end_us"))
    return sessions(points, keys, idle)


def residency(jobs: DataFrame, keys: list[str], idle: int = IDLE_MICROS) -> DataFrame:
    """Spans a model stays loaded: while a job is open, then ``idle`` longer."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = jobs.select(*keys, micros("queued_ts").alias("start_us"), micros("ended_ts").alias("end_us"))
    return sessions(spans, keys, idle)


_VERDICT = "batch_id long, item_id long, generation long, accepted boolean"


def _replay(overloaded: DataFrame, cap: int) -> DataFrame:
    """Replays busy periods in which the cap can be reached, event by event.

    Rows stream through in order; the state is the pending bytes and the open
    jobs that were refused.
    """

    def fold(batches):
        period, pending, refused = None, 0, set()
        for pdf in batches:
            verdicts = []
            for row in pdf.itertuples(index=False):
                if (row.batch_id, row.period) != period:
                    period, pending, refused = (row.batch_id, row.period), 0, set()
                job = (row.item_id, row.generation)
                if row.delta < 0:
                    if job in refused:
                        refused.discard(job)
                    else:
                        pending += row.delta
                    verdicts.append(None)
                elif pending + row.bytes > cap:
                    refused.add(job)
                    verdicts.append(False)
                else:
                    pending += row.bytes
                    verdicts.append(True)
            told = pdf[["batch_id", "item_id", "generation"]].assign(accepted=verdicts)
            yield told[told["accepted"].notna()].astype({"accepted": "bool"})

    placed = overloaded.repartition("batch_id", "period").sortWithinPartitions(
        "batch_id", "period", "at", "delta", "item_id", "generation"
    )
    return placed.mapInPandas(fold, _VERDICT)


def admit_jobs(jobs: DataFrame, cap: int = MAX_PENDING_BYTES, stretch: int = STRETCH) -> DataFrame:
    """(queue, job, accepted): refused when pending bytes would pass the cap.

    A refused job adds nothing, so admission depends on earlier refusals. The
    bytes pending if everything were admitted are an upper bound, and linear:
    running totals give them for all events at once. Where that bound falls to
    zero, nothing can be pending and the queue splits into independent
    periods. Only periods whose bound passes the cap are replayed in order.
    """
    arrive = F.unix_micros(F.col("queued_ts").cast("timestamp"))
    leave = F.unix_micros(F.col("ended_ts").cast("timestamp"))
    ids = ["batch_id", *JOB, "bytes"]
    deltas = jobs.select(
        *ids,
        F.inline(
            F.array(
                F.struct(arrive.alias("at"), F.col("bytes").alias("delta"), F.lit(1).alias("open")),
                F.struct(leave.alias("at"), (-F.col("bytes")).alias("delta"), F.lit(-1).alias("open")),
            )
        ),
    ).filter(F.col("at").isNotNull())
    ties = ("delta", "item_id", "generation")
    counted = running_totals(
        cut_lineage(deltas), ["batch_id"], "at", {"_bytes": "delta", "_open": "open"}, ties, stretch
    )
    begins = ((F.col("_open") == 0) & (F.col("open") == 1)).cast("int")
    flagged = counted.withColumn("_begins", begins)
    numbered = running_total(flagged, ["batch_id"], "at", "_begins", "_earlier", ties, stretch)
    periods = cut_lineage(
        numbered.withColumn("period", F.col("_earlier") + F.col("_begins")).select(
            *ids, "at", "delta", "period", (F.col("_bytes") + F.col("delta")).alias("_after")
        )
    )
    peaks = periods.groupBy("batch_id", "period").agg(F.max("_after").alias("_peak"))
    judged = periods.join(peaks, ["batch_id", "period"])
    calm = judged.filter((F.col("_peak") <= cap) & (F.col("delta") >= 0)).select(
        "batch_id", *JOB, F.lit(True).alias("accepted")
    )
    replayed = _replay(judged.filter(F.col("_peak") > cap).drop("_peak", "_after"), cap)
    return calm.unionByName(replayed)
