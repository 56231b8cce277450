"""Stateful job streams: lifecycle, batch settlement, admission, sessions, residency.

State is kept per key in the state store, and ends: a job's some time after its
end, a batch's with its last open job, a model's when its residency is over. A
trigger hands over the rows of a key for that trigger only, which the source's
rate limit bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from operator import attrgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.jobs import IDLE_MICROS, MAX_PENDING_BYTES

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> SparkSession:
    """Keyed map state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return spark


def read_job_events(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Job events from a folder of parquet files, oldest file first."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    )


def _in_order(chunks: Iterator, *by: str) -> Iterator:
    """The rows of a key's chunks in one order; each chunk is sorted on its own."""
    sorted_chunks = [c.sort_values(list(by)).itertuples(index=False) for c in chunks]
    return merge(*sorted_chunks, key=attrgetter(*by))


def _millis(moment) -> int:
    """Milliseconds since 1970 of a time without zone, which is in UTC."""
    return int(moment.timestamp() * 1000)


_LIFECYCLE = (
    "item_id long, generation long, batch_id long, bytes long, status string, "
    "previous string, cancel_requested boolean, queued_ts timestamp, ended_ts timestamp"
)


def lifecycle_stream(events: DataFrame, late: str = "10 minutes", kept_seconds: int = 3600) -> DataFrame:
    """One row per job and trigger in which its status changed.

    ``previous`` is the status before the trigger, so a consumer can turn the
    rows into +1/-1 changes. A job that has ended emits nothing more.

    Events of a trigger are applied by (ts, seq); triggers are applied as they
    come. The source must deliver a job's events in order, as a log with one
    partition per job does. Where it does not, ``newest_generation_stream``
    gives the state that does not depend on the order of arrival.

    Events more than ``late`` behind the newest are dropped. A job that has
    ended is remembered until the watermark is ``kept_seconds`` past its end, so
    that stray events do not begin it anew; then its state is removed.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Lifecycle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.job = handle.getValueState(
                "job",
                "status string, asked boolean, batch_id long, bytes long, queued timestamp, ended timestamp",
            )

        def handleInputRows(self, key, rows, timerValues):
            kept = self.job.get() if self.job.exists() else (None, False, None, None, None, None)
            status, asked, batch_id, size, queued, ended = kept
            before, was_open = status, ended is None
            for row in _in_order(rows, "ts", "seq"):
                event = row.status
                if status is None:
                    if event == "queued":
                        status, batch_id, size, queued = "queued", row.batch_id, row.bytes, row.ts
                elif status == "queued":
                    if event == "running":
                        status = "running"
                    elif event == "cancel_requested":
                        status, ended = "cancelled", row.ts
                elif status == "running":
                    if event == "cancel_requested":
                        asked = True
                    elif event == "failed":
                        status, ended = "failed", row.ts
                    elif event == "completed":
                        status, ended = ("cancelled" if asked else "completed"), row.ts
            if status is None:
                return
            self.job.update((status, bool(asked), int(batch_id), int(size), queued, ended))
            if was_open and ended is not None:
                self.handle.registerTimer(_millis(ended) + 1000 * kept_seconds)
            if status != before:
                yield pd.DataFrame(
                    {
                        "item_id": [key[0]],
                        "generation": [key[1]],
                        "batch_id": [int(batch_id)],
                        "bytes": [int(size)],
                        "status": [status],
                        "previous": [before],
                        "cancel_requested": [bool(asked)],
                        "queued_ts": [queued],
                        "ended_ts": pd.Series([ended], dtype="datetime64[ns]"),
                    }
                )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.job.clear()
            return iter([])

        def close(self) -> None:
            pass

    return events.withWatermark("ts", late).groupBy("item_id", "generation").transformWithStateInPandas(
        statefulProcessor=Lifecycle(),
        outputStructType=_LIFECYCLE,
        outputMode="Append",
        timeMode="EventTime",
    )


def settled_stream(changes: DataFrame) -> DataFrame:
    """Emits a row each time the last open job of a batch ends.

    ``changes``: batch_id, token, state (``open``, ``ended`` or ``unknown``).
    A submission counts as open from its reservation; a rejected one ends at
    once; an unknown outcome keeps the batch open.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Settled(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.open = handle.getMapState("open", "token string", "one int")
            self.count = handle.getValueState("count", "n long")

        def handleInputRows(self, key, rows, timerValues):
            n = self.count.get()[0] if self.count.exists() else 0
            drained = []
            for row in _in_order(rows, "seq"):
                held = self.open.containsKey((row.token,))
                if row.state == "open" and not held:
                    self.open.updateValue((row.token,), (1,))
                    n += 1
                elif row.state == "ended" and held:
                    self.open.removeKey((row.token,))
                    n -= 1
                    if n == 0:
                        drained.append(row.seq)
            if n:
                self.count.update((n,))
            else:  # nothing is open: nothing is kept
                self.count.clear()
            if drained:
                yield pd.DataFrame({"batch_id": [key[0]] * len(drained), "seq": drained})

        def close(self) -> None:
            pass

    return changes.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=Settled(),
        outputStructType="batch_id long, seq long",
        outputMode="Append",
        timeMode="None",
    )


def admission_stream(moves: DataFrame, cap: int = MAX_PENDING_BYTES) -> DataFrame:
    """Accepts or refuses each arriving job by the bytes still pending.

    ``moves``: batch_id, seq, item_id, generation, bytes, arrives (boolean).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Admission(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.pending = handle.getValueState("pending", "bytes long")
            self.held = handle.getMapState("held", "job string", "bytes long")

        def handleInputRows(self, key, rows, timerValues):
            pending = self.pending.get()[0] if self.pending.exists() else 0
            verdicts = []
            for row in _in_order(rows, "seq"):
                job = (f"{row.item_id}/{row.generation}",)
                if row.arrives:
                    ok = pending + row.bytes <= cap
                    if ok:
                        pending += int(row.bytes)
                        self.held.updateValue(job, (int(row.bytes),))
                    verdicts.append((key[0], row.item_id, row.generation, ok))
                elif self.held.containsKey(job):
                    pending -= self.held.getValue(job)[0]
                    self.held.removeKey(job)
            self.pending.update((pending,))
            if verdicts:
                yield pd.DataFrame(
                    verdicts, columns=["batch_id", "item_id", "generation", "accepted"]
                )

        def close(self) -> None:
            pass

    return moves.groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=Admission(),
        outputStructType="batch_id long, item_id long, generation long, accepted boolean",
        outputMode="Append",
        timeMode="None",
    )


def residency_stream(
    events: DataFrame, keys: list[str], idle: int = IDLE_MICROS, late: str = "10 minutes"
) -> DataFrame:
    """Activity sessions, emitted once the watermark has passed their end.

    As in the batch form, events exactly ``idle`` microseconds apart are two
    sessions; session windows merge where they touch, so the gap is one less.
    Events later than ``late`` are dropped by the watermark, and the query's
    progress counts them (``numRowsDroppedByWatermark``).
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(*keys, F.session_window("ts", f"{idle - 1} microseconds").alias("span"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select(
        *keys, F.col("span.start").alias("start_ts"), "last_ts", "n"
    )


def residency_moves(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs, or their lifecycle changes, as moves (keys, ts, delta): +1 when queued, -1 when ended.

    Of lifecycle changes, a job's first row (without ``previous``) opens it.
    """
    new = F.col("previous").isNull() if "previous" in jobs.columns else F.lit(True)
    moves = F.array(
        F.struct(F.when(new, F.col("queued_ts").cast("timestamp")).alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col("ended_ts").cast("timestamp").alias("ts"), F.lit(-1).alias("delta")),
    )
    return jobs.select(*keys, F.inline(moves)).where("ts is not null")


def residency_spans_stream(
    moves: DataFrame, keys: list[str], idle: int = IDLE_MICROS, late: str = "10 minutes"
) -> DataFrame:
    """Spans a model stays loaded, emitted once they are over: as ``operators.jobs.residency``.

    ``moves``: keys, ts, delta (+1: a job opens, -1: it ends). A span lasts
    while jobs are open and ends ``idle`` microseconds after the last of them.
    Moves may come in any order within ``late``: they wait until the watermark
    has passed them and are then applied in order of time. State is the moves
    that wait, the jobs that are open and where the span began; nothing is kept
    of a span that is over. Rows: keys, start_ts, end_ts (of the last job), n (jobs).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    fields = [f"{k} {moves.schema[k].dataType.simpleString()}" for k in keys]

    class Residency(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at long, delta int")
            self.span = handle.getValueState("span", "start long, last long, open int, jobs long")

        def handleInputRows(self, key, rows, timerValues):
            last = None
            for chunk in rows:
                at = chunk["ts"].astype("datetime64[us]").astype("int64")
                for row in zip(at.tolist(), chunk["delta"].tolist()):
                    self.waiting.appendValue(row)
                    last = row[0] if last is None else max(last, row[0])
            if last is not None:
                self.handle.registerTimer(-(-last // 1000))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            due, wait = [], []
            for at, delta in self.waiting.get():
                (due if at <= passed else wait).append((at, delta))
            if due:
                if wait:
                    self.waiting.put(wait)
                else:
                    self.waiting.clear()
            start, last, open_, jobs = self.span.get() if self.span.exists() else (None, None, 0, 0)
            over = []
            for at, delta in sorted(due, key=lambda m: (m[0], -m[1])):  # a job opens before it ends
                if delta > 0:
                    if start is not None and not open_ and at - last >= idle:
                        over.append((start, last, jobs))
                        start, jobs = None, 0
                    start = at if start is None else start
                    open_, jobs = open_ + 1, jobs + 1
                else:
                    open_ -= 1
                last = at if last is None else max(last, at)
            if start is not None and not open_ and last + idle <= passed:
                over.append((start, last, jobs))
                start = None
            if start is None:
                self.span.clear()
            else:
                self.span.update((start, last, open_, jobs))
                if not open_:
                    self.handle.registerTimer(-(-(last + idle) // 1000))
            if over:
                columns = {k: [v] * len(over) for k, v in zip(keys, key)}
                for i, name in enumerate(("start_ts", "end_ts")):
                    columns[name] = pd.to_datetime([o[i] for o in over], unit="us")
                yield pd.DataFrame(columns | {"n": [o[2] for o in over]})

        def close(self) -> None:
            pass

    timed = moves.withWatermark("ts", late)
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Residency(),
        outputStructType=", ".join([*fields, "start_ts timestamp", "end_ts timestamp", "n long"]),
        outputMode="Append",
        timeMode="EventTime",
    )


def newest_generation_stream(events: DataFrame) -> DataFrame:
    """The state each item shows, kept up to date; older generations never win."""
    order = F.struct("generation", "ts", "seq")
    return events.groupBy("item_id").agg(
        F.max("generation").alias("generation"), F.max_by("status", order).alias("status")
    )


def without_repeats(events: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Drops redelivered responses."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within)
    return timed.dropDuplicatesWithinWatermark(keys)


def status_deltas(changes: DataFrame) -> DataFrame:
    """Lifecycle changes as +1 for the new status and -1 for the previous one."""
    return changes.select(
        "batch_id",
        F.inline(
            F.array(
                F.struct(F.col("status").alias("status"), F.lit(1).alias("delta")),
                F.struct(F.col("previous").alias("status"), F.lit(-1).alias("delta")),
            )
        ),
    ).filter(F.col("status").isNotNull())


def live_counters_stream(deltas: DataFrame) -> DataFrame:
    """Jobs per batch and status; sums of changes, combined map-side."""
    return deltas.groupBy("batch_id", "status").agg(F.sum("delta").alias("jobs"))
