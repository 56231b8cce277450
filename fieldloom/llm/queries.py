"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import (
    bin_slack,
    decontaminate,
    exact_dedup,
    filter_audit,
    langid,
    lexical_search,
    licenses,
    mixing,
    ngram_lm,
    quality,
    simhash,
    token_counts,
    token_files,
)
from fieldloom.llm.common import documents

Run = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_digest(documents(spark, sf_dir), path)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaks(documents(spark, sf_dir), items)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(documents(spark, sf_dir), labels)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(documents(spark, sf_dir), path)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical_search.search(documents(spark, sf_dir), items)


def op12_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bin_slack.packed_pieces(documents(spark, sf_dir), path)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.filter_audit(documents(spark, sf_dir), labels)


QUERIES: dict[str, Run] = {
    run.__name__: run
    for run in (
        op1_mixing,
        op2_simhash,
        op3_token_files,
        op4_decontamination,
        op5_quality,
        op6_language_id,
        op7_license_scan,
        op8_exact_dedup,
        op9_lm_scores,
        op10_token_counts,
        op11_lexical_search,
        op12_bin_slack_packing,
        op13_filter_audit,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

#: What SQL can express; the other queries are tested against plain Python.
ORACLES: dict[str, str] = {
    "op7_license_scan": licenses.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
