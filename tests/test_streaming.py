"""Streams give what their batch forms give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import SMALL_SF_DIR as SMALL
from fieldloom.catalog.views import PROFILE, spark_view, xml_documents
from fieldloom.operators import attachments, jobs, undo
from fieldloom.streaming import arrivals, status
from fieldloom.streaming import jobs as job_streams


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def drain(stream, name, mode="append", kept=None):
    """The stream's whole output; ``kept`` gets the state rows after each trigger."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120), query.lastProgress
    if kept is not None:
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def job_files(spark, tmp_path_factory):
    """Job events in time order, three files; and their schema."""
    path = str(tmp_path_factory.mktemp("jobs"))
    events = spark_view(spark, SMALL, "v_jobs").withColumn("ts", F.col("ts").cast("timestamp"))
    numbered = events.toPandas().sort_values(["ts", "seq"]).reset_index(drop=True)
    for part in range(3):
        chunk = numbered[numbered.index * 3 // len(numbered) == part]
        spark.createDataFrame(chunk, events.schema).coalesce(1).write.mode("append").parquet(path)
    return path, events


def test_lifecycle_matches_batch(spark, job_files):
    path, events = job_files
    job_streams.use_state_store(spark)
    source = job_streams.read_job_events(spark, path, events.schema)
    stream = job_streams.lifecycle_stream(source, kept_seconds=10**9)
    changes = drain(stream, "lifecycle_changes")
    last = changes.groupBy("item_id", "generation").agg(
        F.max_by("status", F.struct(F.coalesce("ended_ts", "queued_ts"), F.col("previous").isNotNull())).alias("status")
    )
    ended = ("completed", "failed", "cancelled")
    expected = jobs.lifecycle(events).filter(F.col("status").isin(*ended)).select("item_id", "generation", "status")
    assert rows(last.filter(F.col("status").isin(*ended))) == rows(expected)
    # Counters summed from the changes equal the batch counts of all jobs.
    counted = job_streams.live_counters_stream(job_streams.status_deltas(changes)).filter("jobs <> 0")
    batch = jobs.lifecycle(events).groupBy("batch_id", "status").agg(F.count(F.lit(1)).alias("jobs"))
    assert rows(counted) == rows(batch)


def test_state_of_ended_jobs_is_removed(spark, folder):
    """All jobs end; an hour later nothing is kept, and stray events before that change nothing."""
    names = {"q": "queued", "r": "running", "d": "completed", "f": "failed", "c": "cancel_requested"}
    scripts = ["qrd", "qrf", "qc", "qrcd", "qrdc"]
    script = [(job, 1, 5, seq, f"2024-01-01 00:{seq:02d}:{job:02d}", names[e], 8) for job in range(30) for seq, e in enumerate(scripts[job % 5])]
    script.append((0, 1, 5, 9, "2024-01-01 00:40:00", "queued", 8))  # a stray event of a job that has ended
    clock = [(99, 1, 5, 0, f"2024-01-0{d} 00:00:00", "running", 8) for d in (2, 3)]  # moves the watermark, begins no job
    schema = "item_id long, generation long, batch_id long, seq long, ts string, status string, bytes long"
    for i, part in enumerate((script, clock[:1], clock[1:])):
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(folder + "/in")
    job_streams.use_state_store(spark)
    kept = []
    source = job_streams.read_job_events(spark, folder + "/in", frame.schema)
    changes = drain(job_streams.lifecycle_stream(source), "ended_jobs", kept=kept)
    assert max(kept) >= 30 and kept[-1] == 0
    batch = jobs.lifecycle(spark.read.parquet(folder + "/in"))
    assert rows(changes.select("item_id", "status")) == rows(batch.select("item_id", "status"))


def intervals(spark, spans):
    """Jobs from (key, start minute, end minute or null)."""
    frame = spark.createDataFrame(
        [(k, i, float(a), None if b is None else float(b)) for i, (k, a, b) in enumerate(spans)], "batch_id long, item_id long, a double, b double"
    )
    at = lambda c: F.timestamp_micros((F.lit(1_704_067_200_000_000) + F.round(F.col(c) * 60_000_000)).cast("long"))
    return frame.select("batch_id", "item_id", at("a").alias("queued_ts"), at("b").alias("ended_ts"))


def test_residency_spans_match_batch(spark, folder):
    """Jobs longer than the gap, nested, back to back, exactly the gap apart, and still open ones."""
    spans = [(1, 0, 30), (1, 10, 12), (1, 34, 36), (1, 41, 41), (1, 45.99, 47), (1, 60, 61), (2, 0, 90), (2, 3, None), (2, 200, 201), (3, 5, 5), (3, 10, 11)]
    table = intervals(spark, spans)
    moves = job_streams.residency_moves(table, ["batch_id"])
    numbered = moves.toPandas().sample(frac=1, random_state=3).reset_index(drop=True)
    for part in range(3):  # any order; the bound on lateness is wide enough
        spark.createDataFrame(numbered[numbered.index % 3 == part], moves.schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    end = pd.DataFrame({"batch_id": [9, 9], "ts": [pd.Timestamp("2024-01-03"), pd.Timestamp("2024-01-03")], "delta": [1, -1]})
    spark.createDataFrame(end, moves.schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    job_streams.use_state_store(spark)
    source = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    kept = []
    told = drain(job_streams.residency_spans_stream(source, ["batch_id"], late="1 day"), "spans", kept=kept)
    streamed = rows(told.select("batch_id", F.unix_micros("start_ts"), F.unix_micros("end_ts"), "n"))
    batch = rows(jobs.residency(table, ["batch_id"]).where("end_us is not null").select("batch_id", "start_us", "end_us", "n"))
    assert streamed == batch and len(batch) == 5
    assert {r.batch_id for r in jobs.residency(table, ["batch_id"]).where("end_us is null").collect()} == {2}
    assert 0 < kept[-1] < max(kept)  # the span of the open job, and the moves that wait


def test_residency_spans_of_all_jobs(spark, job_files, folder):
    """Lifecycle changes as they come give the spans of the batch form, and no state is left."""
    _, events = job_files
    table = jobs.lifecycle(events).where("ended_ts is not null")
    moves = job_streams.residency_moves(table, ["batch_id"])
    ordered = moves.toPandas().sort_values("ts").reset_index(drop=True)
    end = ordered["ts"].max() + pd.Timedelta(days=2)
    clock = pd.DataFrame({"batch_id": [99, 99], "ts": [end, end], "delta": [1, -1]})
    later = clock.assign(ts=end + pd.Timedelta(days=1))
    for part in [*(ordered[ordered.index * 3 // len(ordered) == i] for i in range(3)), clock, later]:
        spark.createDataFrame(part, moves.schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    job_streams.use_state_store(spark)
    source = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    kept = []
    told = drain(job_streams.residency_spans_stream(source, ["batch_id"]), "all_spans", kept=kept).where("batch_id < 99")
    streamed = rows(told.select("batch_id", F.unix_micros("start_ts"), F.unix_micros("end_ts"), "n"))
    assert streamed == rows(jobs.residency(table, ["batch_id"]).select("batch_id", "start_us", "end_us", "n"))
    assert len(streamed) > 7 and kept[-1] <= 2 < max(kept)  # the last two moves of the clock still wait


def test_newest_generation_matches_batch(spark, job_files):
    path, events = job_files
    stream = job_streams.newest_generation_stream(job_streams.read_job_events(spark, path, events.schema))
    assert rows(drain(stream, "newest_generation", "complete")) == rows(jobs.newest_generation(events))


def test_residency_matches_batch_for_closed_sessions(spark, job_files):
    path, events = job_files
    source = job_streams.read_job_events(spark, path, events.schema)
    stream = job_streams.residency_stream(source, ["batch_id"], late="0 seconds")
    closed = drain(stream, "residency").select(
        "batch_id", F.unix_micros("start_ts"), F.unix_micros("last_ts"), "n"
    )
    batch = jobs.event_sessions(events, ["batch_id"]).select("batch_id", "start_us", "end_us", "n")
    streamed, expected = set(rows(closed)), set(rows(batch))
    assert streamed <= expected
    # The last session of each batch is open until the watermark passes its end.
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    assert {r for r in expected - streamed if r[2] + jobs.IDLE_MICROS < last} == set()


def test_sessions_part_at_the_exact_gap(spark, folder):
    at = [0, 299_999_999, 299_999_999 + 300_000_000, 10**10]
    events = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "batch_id long, seq long, us long")
    events = events.selectExpr("batch_id", "seq", "timestamp_micros(us) ts")
    events.write.parquet(folder + "/gap")
    source = spark.readStream.schema(events.schema).parquet(folder + "/gap")
    stream = job_streams.residency_stream(source, ["batch_id"], late="0 seconds")
    closed = drain(stream, "gap").select("batch_id", F.unix_micros("start_ts"), F.unix_micros("last_ts"), "n")
    batch = jobs.event_sessions(events, ["batch_id"]).select("batch_id", "start_us", "end_us", "n")
    assert sorted(rows(batch)) == [(1, 0, at[1], 2), (1, at[2], at[2], 1), (1, at[3], at[3], 1)]
    assert set(rows(closed)) == set(rows(batch)) - {(1, at[3], at[3], 1)}


def test_settled_fires_once_per_drain(spark, folder):
    changes = [
        (1, 1, "a", "open"), (1, 2, "b", "open"), (1, 3, "a", "ended"), (1, 4, "b", "ended"),
        (1, 5, "c", "open"), (1, 6, "c", "unknown"), (1, 7, "b", "ended"),
        (2, 1, "x", "open"), (2, 2, "x", "ended"), (2, 3, "y", "open"), (2, 4, "y", "ended"),
    ]
    schema = "batch_id long, seq long, token string, state string"
    spark.createDataFrame(changes, schema).coalesce(1).write.parquet(folder + "/in")
    job_streams.use_state_store(spark)
    stream = job_streams.settled_stream(spark.readStream.schema(schema).parquet(folder + "/in"))
    kept = []
    assert rows(drain(stream, "settled", kept=kept)) == [(1, 4), (2, 2), (2, 4)]
    assert kept[-1] == 2  # batch 1 has an open job: its token and its count


def test_admission_matches_batch(spark, job_files, folder):
    _, events = job_files
    table = jobs.lifecycle(events)
    cap = 60_000_000
    moves = table.select(
        "batch_id", "item_id", "generation", "bytes",
        F.inline(F.array(
            F.struct(F.col("queued_ts").alias("at"), F.lit(True).alias("arrives")),
            F.struct(F.col("ended_ts").alias("at"), F.lit(False).alias("arrives")),
        )),
    ).filter("at is not null")
    ordered = moves.toPandas().sort_values(["at", "arrives"]).reset_index(drop=True)
    ordered["seq"] = ordered.index
    frame = spark.createDataFrame(ordered.drop(columns="at"))
    for part in range(2):
        frame.filter((F.col("seq") >= len(ordered) // 2) == bool(part)).coalesce(1).write.mode("append").parquet(folder + "/in")
    job_streams.use_state_store(spark)
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    streamed = drain(job_streams.admission_stream(source, cap), "admission")
    batch = jobs.admit_jobs(table, cap)
    verdicts = {r["accepted"] for r in batch.select("accepted").distinct().collect()}
    assert verdicts == {True, False}
    columns = ["batch_id", "item_id", "generation", "accepted"]
    assert rows(streamed.select(*columns)) == rows(batch.select(*columns))


def test_admission_batch_equals_replay(spark, job_files):
    """Brute force over a small fixture, for several stretch widths."""
    _, events = job_files
    table = jobs.lifecycle(events).cache()
    cap = 40_000_000
    pdf = table.toPandas()
    expected = {}
    for batch_id, part in pdf.groupby("batch_id"):
        moves = [(r.queued_ts, r.bytes, r.item_id, r.generation, 1) for r in part.itertuples()]
        moves += [(r.ended_ts, -r.bytes, r.item_id, r.generation, -1) for r in part.itertuples() if not pd.isna(r.ended_ts)]
        pending, held = 0, set()
        for _, delta, item, generation, kind in sorted(moves, key=lambda m: (m[0], m[1], m[2], m[3])):
            if kind == 1:
                ok = pending + delta <= cap
                expected[(batch_id, item, generation)] = ok
                if ok:
                    pending += delta
                    held.add((item, generation))
            elif (item, generation) in held:
                pending += delta
    for stretch in (20, 1 << 18):
        got = {(r[0], r[1], r[2]): r[3] for r in jobs.admit_jobs(table, cap, stretch).collect()}
        assert got == expected


def test_arrivals_equal_batch(spark, folder):
    documents = xml_documents(spark, SMALL).select("doc_id", F.col("xml").cast("binary").alias("content"))
    documents.repartition(3).write.parquet(folder + "/in")
    source = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    query = arrivals.write_proposals(arrivals.xml_proposals(source), folder + "/out", folder + "/checkpoint")
    assert query.awaitTermination(120)
    batch = arrivals.xml_proposals(spark.read.parquet(folder + "/in"))
    assert rows(spark.read.parquet(folder + "/out")) == rows(batch)


def test_arrivals_judge_as_discovery_does(spark, folder):
    good = xml_documents(spark, SMALL).select("doc_id", "xml").limit(40).collect()
    rows_, names = [], ("factur-x.xml", "zugferd-invoice.xml", "notes.xml")
    for i, r in enumerate(good):
        xml = r["xml"]
        if i % 5 == 1:
            xml = xml.replace(PROFILE, "urn:other:profile")
        elif i % 5 == 2:
            xml = xml.replace("CrossIndustryInvoice", "CrossIndustryOrder")
        elif i % 5 == 3:
            xml = xml[:-20]
        rows_.append((r["doc_id"], names[i % 3], 1, bytearray(xml.encode())))
    table = spark.createDataFrame(rows_, "doc_id long, attachment_name string, revision_no int, content binary")
    found = attachments.discover_xml(table.select("doc_id"), table).filter("xml_status <> 'none'")
    table.write.parquet(folder + "/judged")
    source = spark.readStream.schema(table.schema).parquet(folder + "/judged")
    query = arrivals.write_proposals(arrivals.xml_proposals(source), folder + "/judged-out", folder + "/judged-checkpoint")
    assert query.awaitTermination(120)
    told = spark.read.parquet(folder + "/judged-out")
    columns = ["doc_id", "xml_status", "xml_warning"]
    assert rows(told.select(columns)) == rows(found.select(columns))
    assert {r["xml_status"] for r in told.collect()} == {"supported", "unsupported", "invalid"}
    assert told.filter("xml_status <> 'supported' and size(xml_fields_used) > 0").count() == 0


def test_memory_and_redo_views(spark, folder):
    samples = spark_view(spark, SMALL, "v_mem").withColumn("ts", F.col("ts").cast("timestamp"))
    samples.repartition(2).write.parquet(folder + "/mem")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/mem")
    from fieldloom.operators.fleet import latest_memory

    assert rows(drain(status.memory_stream(stream), "memory", "complete")) == rows(latest_memory(samples))
    ledger = spark.createDataFrame(
        [("w", 1, "rename", 2), ("w", 2, "undo", 2), ("v", 1, "undo", 1), ("v", 2, "rename", 1), ("u", 1, "undo", 0)],
        "workspace_id string, seq long, operation string, n_reversed long",
    )
    ledger.write.parquet(folder + "/ledger")
    stream = spark.readStream.schema(ledger.schema).parquet(folder + "/ledger")
    assert rows(drain(status.redo_stream(stream), "redo", "complete")) == rows(undo.redo_state(ledger))
    assert rows(undo.redo_state(ledger)) == [("u", False, 0), ("v", False, 0), ("w", True, 2)]


def test_repeated_responses_are_dropped(spark, folder):
    events = spark.createDataFrame(
        [(1, 1, "a"), (1, 1, "a"), (2, 1, "b")], "item_id long, seq long, status string"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    events.write.parquet(folder + "/in")
    stream = spark.readStream.schema(events.schema).parquet(folder + "/in")
    kept = drain(job_streams.without_repeats(stream, ["item_id", "seq"]), "repeats")
    assert kept.count() == 2
