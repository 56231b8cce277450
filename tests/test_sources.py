"""Readers and writers on real folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import fleet, prompts
from fieldloom.plans.progress import observe_progress
from fieldloom.sources import documents, labels, ledger, reports


def put(path, content=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)


def test_document_scan_keeps_supported_files_and_repeats(spark, folder):
    for name in ("a.PDF", "b.pdf", "c.Jpg", "d.jpeg", "e.png", "f.pdf.txt"):
        put(f"{folder}/in/{name}", b"%PDF-1" if "d" in name.lower() else b"\xff\xd8\xff")
    scanned = documents.scan_documents(spark, f"{folder}/in", f"{folder}/in/b.pdf")
    names = sorted(r["file_name"] for r in scanned.select("file_name").collect())
    assert names == ["a.PDF", "b.pdf", "b.pdf", "c.Jpg", "d.jpeg"]
    formats = documents.with_format(scanned).filter("file_name = 'c.Jpg'").collect()[0]
    assert formats["format"] == "jpeg"
    stream = documents.stream_documents(spark, f"{folder}/in").select("file_name")
    query = stream.writeStream.format("memory").queryName("scan").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert spark.table("scan").count() == 4


def test_labels_keep_null_and_absent_apart(spark, folder):
    put(f"{folder}/labels.json", json.dumps({"a.pdf": {"seller": None, "currency": "EUR"}, "b.pdf": {}}).encode())
    got = sorted(map(tuple, labels.read_labels(spark, f"{folder}/labels.json").collect()))
    assert got == [("a.pdf", "currency", "EUR"), ("a.pdf", "seller", None)]


def test_history_missing_is_empty_and_corrupt_is_an_error(spark, folder):
    assert ledger.read_history(spark, f"{folder}/none").count() == 0
    assert ledger.read_history_json(spark, f"{folder}/none").count() == 0
    put(f"{folder}/bad/part.parquet", b"not parquet")
    with pytest.raises(Exception):
        ledger.read_history(spark, f"{folder}/bad").count()
    put(f"{folder}/bad.json", b'{"batch_id": ')
    with pytest.raises(Exception):
        ledger.read_history_json(spark, f"{folder}/bad.json").collect()
    event = spark.createDataFrame([("b", 1, None, "/s", "/d", "i", "renamed")], ledger.HISTORY_SCHEMA)
    ledger.append_history(event, f"{folder}/h")
    ledger.append_history(event, f"{folder}/h")
    assert ledger.read_history(spark, f"{folder}/h").count() == 2


def test_report_versions_and_replayed_batches(spark, folder):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "model_id string, runs int")
    new = spark.createDataFrame([("a", 9)], "model_id string, runs int")
    reports.write_report(spark, old, None, f"{folder}/v1")
    reports.write_report(spark, new, f"{folder}/v1", f"{folder}/v2")
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/v2").collect())) == [("a", 9), ("b", 2)]
    write = reports.results_sink(f"{folder}/rows")
    write(old, 0)
    write(old, 0)
    write(new, 1)
    assert spark.read.parquet(f"{folder}/rows").count() == 3
    reports.append_results(old, f"{folder}/appended")
    done = spark.read.parquet(f"{folder}/appended").selectExpr("model_id", "runs doc_id")
    left = reports.unfinished(old.union(new).selectExpr("model_id", "runs doc_id"), done)
    assert list(map(tuple, left.collect())) == [("a", 9)]


def test_rename_plan_is_written_once(spark, folder):
    plan = spark.createDataFrame([("b", "1", "/s", "/d")], "batch_id string, request_id string, source_path string, destination_path string")
    ledger.write_plan(plan, f"{folder}/plan")
    with pytest.raises(Exception):
        ledger.write_plan(plan, f"{folder}/plan")


def test_manifest_audit_reads_folders(spark, folder):
    import hashlib

    put(f"{folder}/models/m/w/x.bin", b"abc")
    put(f"{folder}/models/m/y.bin", b"abcd")
    observed = documents.observed_files(spark, f"{folder}/models")
    digest = hashlib.sha256(b"abc").hexdigest()
    expected = spark.createDataFrame(
        [("m", "w/x.bin", 3, digest), ("m", "y.bin", 3, digest), ("m", "z.bin", 1, digest)],
        "model_id string, path string, expected_size long, expected_digest string",
    )
    audit = fleet.audit_files(expected, observed)
    got = {r["path"]: r["verdict"] for r in audit.collect()}
    assert got == {"w/x.bin": "verified", "y.bin": "size mismatch", "z.bin": "missing"}
    assert fleet.installed_models(audit).collect()[0]["installed"] is False


def test_scorer_loads_only_where_there_are_prompts(spark):
    def load_scorer():
        raise RuntimeError("must not load")

    empty = spark.createDataFrame([], "doc_id long, prompt string")
    assert prompts.score_prompts(empty, load_scorer).count() == 0
    one = spark.createDataFrame([(1, "p")], "doc_id long, prompt string")
    row = prompts.score_prompts(one, load_scorer).collect()[0]
    assert row["response"] is None and "must not load" in row["error"]


def test_progress_is_observed(spark):
    rows = spark.range(10).withColumn("failed", F.col("id") % 2 == 0)
    observed, progress = observe_progress(rows, "scored")
    observed.write.format("noop").mode("overwrite").save()
    assert progress.get == {"rows": 10, "failed": 5}


def test_batched_scorer_loads_once_per_worker(spark):
    """Few calls for many prompts, one load per process over several tasks, errors of single prompts."""

    def load_scorer():
        import os
        import uuid

        load, calls = uuid.uuid4().hex, [0]

        def scorer(texts):
            calls[0] += 1
            if "raises" in texts:
                raise RuntimeError("this batch")
            return [ValueError("refused") if t == "bad" else f"{os.getpid()}/{load}/{calls[0]}/{max(map(len, texts))}" for t in texts]

        return scorer

    texts = ["x" * (i % 40 + 1) for i in range(2000)] + ["bad", "raises", None, ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, prompt string").repartition(16)
    rows = prompts.score_batches(table, "test_batched", load_scorer, most=50).collect()
    assert len(rows) == len(texts)
    told = [(len(texts[r.k]), *r.response.split("/")) for r in rows if r.response]
    assert len(told) == 2001
    loads = {(pid, load) for _, pid, load, _, _ in told}
    assert len({pid for pid, _ in loads}) == len(loads)
    assert len({(load, call) for _, _, load, call, _ in told}) < len(texts) / 10
    errors = {texts[r.k]: r.error for r in rows if r.error}
    assert errors == {"bad": "ValueError('refused')", "raises": "RuntimeError('this batch')", None: "there is no prompt"}
    broken = prompts.score_batches(table, "test_broken", lambda: 1 / 0).select("error").distinct().collect()
    assert [r.error for r in broken] == ["ZeroDivisionError('division by zero')"]


def test_length_buckets():
    lengths = [5, 1, 9, 1, 30, 2]
    assert list(prompts.length_buckets(lengths, 2, 20)) == [[1, 3], [5, 0], [2], [4]]
    assert list(prompts.length_buckets([], 2, 20)) == []
