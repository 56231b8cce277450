"""Each stage of the pipeline against the operator it calls, on its own input."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from fieldloom.llm import decontaminate, langid, mixing, simhash
from fieldloom.llm.common import BATCH_BYTES, documents, written
from plain_similarity import class_of, close_pairs

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = documents(spark, SMALL)
    names = docs.columns
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        inputs.append(written(stage(spark, inputs[-1], SMALL), "stage"))
        assert inputs[-1].columns == names
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in inputs]
    told = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert ids[1] == [i for i in ids[0] if told[i].lang_pred != "und" and told[i].score >= langid.LEAST_OVER_CHANCE / 4]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(inputs[1]).collect()}
    texts = {r.doc_id: r.text for r in inputs[1].select("doc_id", "text").collect()}
    named = class_of(groups, close_pairs(texts))
    assert ids[2] == sorted(set(named.values()))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    leaked = {r.doc_id for r in decontaminate.leaks(inputs[2], items).collect()}
    assert leaked and ids[3] == [i for i in ids[2] if i not in leaked]
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in ids[4]) == 2
    found = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, inputs[4], SMALL).collect()), key=lambda r: r[1])
    rows = inputs[4].select("doc_id", "text").orderBy("doc_id").collect()
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = Tokenizer.from_file(path).encode_batch([r.text for r in rows], add_special_tokens=False)
    ids = [np.array([*e.ids, 1], "<u4") for e in encoded]
    starts = np.cumsum([0] + [len(i) for i in ids])
    assert found == [(r.doc_id, int(s), len(i), zlib.crc32(i.tobytes())) for r, s, i in zip(rows, starts, ids)]


ODD = [
    (1, "a text that is told apart by its address alone, in English", "en", "s", 5, {"a": 1}, "x"),
    (1, "a text that is told apart by its address alone, in English", "en", "s", 5, {"a": 2}, "y"),
    (2, None, None, None, None, None, None), (3, "", "en", "s", 0, {}, "x"), (None, "un texto sin número pero con letras", "es", None, 9, None, "z"),
    (4, "w " * 30_000, "en", "s", 60_000, {"b": 1}, None), (5, "ein deutscher Satz, der hier steht", "de", "s", 1, {}, "x"),
    (5, "ein deutscher Satz, der hier steht", "de", "s", 1, {}, "x"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row map<string,int>, _copies string"


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, a map column and clashing names go through every stage."""
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SMALL), "odd")
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.collect()]
        if name == "language":
            assert 2 not in ids and 3 not in ids and ids.count(1) == 2 and ids.count(5) == 2
        if name == "near_dedup":
            assert len(ids) == len(set(ids))
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    empty = spark.createDataFrame([], ODD_SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_mixture_keeps_rows_apart(spark):
    """Rows of one doc_id and text that differ elsewhere have copies of their own."""
    rows = [(i, "one two three", "en", "s", 1, {"a": k}, f"u{k}") for i in range(20) for k in (1, 2)]
    docs = spark.createDataFrame(rows, ODD_SCHEMA)
    mixed = mixing.mixture(docs).collect()
    assert len(mixed) == 60 and {r._copies for r in mixed} == {"u1", "u2"}
    assert max(mixed.count(r) for r in mixed) <= 2
    alike = spark.createDataFrame([(1, "one two", "en", "s", 1, None, "x")] * 30, ODD_SCHEMA)
    assert mixing.mixture(alike).count() == 45


def test_language_stage_without_labels(spark):
    rows = [(1, "some words", None, "s", 1, None, "x"), (2, "12 !", None, "s", 1, None, "x"), (3, None, "en", "s", 1, None, "x")]
    kept = langid.keep_known(spark.createDataFrame(rows, ODD_SCHEMA))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_batches_are_bounded(spark):
    """Python functions of a stage get a few MB at once, however long the texts are."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    text = F.repeat(F.lit("word "), 20_000)
    docs = spark.range(300, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    corpus_pipeline.STAGES[3][1](spark, docs, SMALL)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    found = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 300 and max(r.size for r in found) < 1.5 * BATCH_BYTES


def test_registered():
    names = contract.queries()
    assert {"pipeline"} | {n.split("_")[0] for n in names if n.startswith("op")} >= {"pipeline"} | {f"op{i}" for i in range(1, 14)}
    assert set(contract.oracle_sql()) <= set(names)
