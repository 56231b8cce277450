"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stages in
between are written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, langid, mixing, similar_texts, simhash, token_files
from fieldloom.llm.common import bound_batches, documents, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; each row that stays is as it was."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with close fingerprints or similar texts, the one of the smallest doc_id stays."""
    return simhash.keep_first(docs, similarity=similar_texts.SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated until the sources have their shares."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their documents as read back from the files."""
    return token_files.token_digest(docs, public_tokenizers.path("word_bpe_49k.json"))



def _bounded(stage: Stage) -> Stage:
    """The stage with bounded batches, whoever made its session."""

    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


STAGES: list[tuple[str, Stage]] = [
    ("language", _bounded(language)),
    ("near_dedup", _bounded(near_dedup)),
    ("decontamination", _bounded(decontamination)),
    ("mixing", _bounded(mix)),
    ("tokens", _bounded(tokens)),
]

#: The network, the random mix and the tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: doc_id, start, n_tokens, ids_crc32."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
