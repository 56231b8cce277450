"""The whole analysis on a stream against the batch analysis."""

import random

from pyspark.sql import functions as F

from compare import SMALL_SF_DIR as SMALL
from fieldloom.catalog.q_plans import analysis_inputs, stray_calls
from fieldloom.plans import analysis
from fieldloom.streaming import analysis as stream_analysis
from fieldloom.streaming.jobs import use_state_store


def shuffled_files(spark, frame, path, files, seed):
    """The rows in mixed order, over several files that arrive one after the other."""
    marked = frame.withColumn("_file", F.pmod(F.xxhash64(*frame.columns, F.lit(seed)), F.lit(files)))
    for part in range(files):
        marked.where(F.col("_file") == part).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def several_attachments(attached):
    """Copies under other names, second contents, empty and too many revisions."""
    other = attached.where("doc_id % 7 = 1").withColumns(
        {"attachment_name": F.lit("xrechnung.xml"), "revision_no": F.lit(1)}
    )
    broken = attached.where("doc_id % 11 = 2").withColumns(
        {"content": F.lit("<x/>").cast("binary"), "revision_no": F.lit(2), "attachment_name": F.lit("zugferd-invoice.xml")}
    )
    empty = attached.where("doc_id % 5 = 3").withColumns({"content": F.lit("").cast("binary"), "revision_no": F.lit(3)})
    many = attached.where("doc_id % 13 = 4").withColumn("revision_no", F.explode(F.sequence(F.lit(4), F.lit(9))))
    return attached.unionByName(other).unionByName(broken).unionByName(empty).unionByName(many)


def test_stream_gives_the_proposals_of_the_batch(spark, folder):
    documents, attached, calls = analysis_inputs(spark, SMALL)
    some = lambda frame: frame.where("doc_id % 10 < 2")
    documents, attached = some(documents), some(several_attachments(attached))
    calls = some(calls.unionByName(stray_calls(calls)))
    streams = [
        shuffled_files(spark, frame, f"{folder}/{name}", 2, name)
        for name, frame in (("documents", documents), ("attached", attached), ("calls", calls))
    ]
    use_state_store(spark)
    versions = stream_analysis.analysis_stream(*streams, max_repairs=1, short_repairs=0)
    query = versions.writeStream.format("parquet").option("path", folder + "/out").option(
        "checkpointLocation", folder + "/checkpoint"
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    told = spark.read.parquet(folder + "/out")
    assert told.agg(F.max("version")).first()[0] > 1
    batch = analysis.analyse(documents, attached, calls, max_repairs=1, short_repairs=0)
    columns = [c for c in batch.columns if c != "evidence"]
    plain = lambda frame: sorted(map(str, frame.select(columns).collect()))
    assert plain(stream_analysis.newest_versions(told)) == plain(batch)
    states = {r.xml_status for r in batch.select("xml_status").distinct().collect()}
    assert states >= {"supported", "ambiguous", "none"}


def test_state_takes_calls_as_the_batch_does():
    """Repeated and ignored calls, and copies of a content, whatever their order."""
    from types import SimpleNamespace as Row

    rows = [
        Row(kind="call", phase="extraction", attempt=0, response=None, error="boom"),
        Row(kind="call", phase="extraction", attempt=0, response="b", error=None),
        Row(kind="call", phase="extraction", attempt=7, response="x", error=None),
        Row(kind="call", phase="review", attempt=0, response="x", error=None),
        Row(kind="content", at=2, attachment_name="b", content_hash="h", facts="2"),
        Row(kind="content", at=1, attachment_name="a", content_hash="h", facts="1"),
        Row(kind="name", at=2, attachment_name="b"), Row(kind="name", at=1, attachment_name="a"),
        Row(kind="document", extension=".pdf", shorten=True),
    ]
    told = []
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        state = {"version": 0, "document": None, "names": {}, "contents": {}, "calls": {}}
        for row in rows:
            stream_analysis.take(state, row)
        told.append(stream_analysis.gathered_row(state, {"extraction": 1, "shortening": 0}))
    assert all(t == told[0] for t in told)
    assert (told[0]["response_0"], told[0]["error_0"], told[0]["calls_ignored"], told[0]["calls_repeated"]) == ("b", None, 2, 1)
    assert (told[0]["n_names"], told[0]["n_contents"], told[0]["facts"], told[0]["content_names"]) == (2, 1, "1", "a")
