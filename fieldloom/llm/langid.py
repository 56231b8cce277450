"""Language ID: a bidirectional gated recurrent network labels every byte.

The probabilities of all positions that hold letters are averaged, so a text
gets the language of most of it. The network is trained on windows of a bounded
number of documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import byte_gru
from fieldloom.llm.common import as_bytes, fold, keep_only, slices

UNDETERMINED = "und"
FOLDS, HELD_FOLD = 4, 2
#: The training sample, bounded for each language: its documents, windows of each, bytes of
#: a window.
DOCS, WINDOWS, LENGTH = 150, 8, 64
HIDDEN, STEPS = 12, 300
#: The pipeline rejects texts whose best language is less than so many times as likely as
#: any language would be by chance.
LEAST_OVER_CHANCE = 1.2

_LETTERS = np.array([chr(c).isalpha() or c >= 128 for c in range(256)])


def held_out(key: str = "doc_id"):
    return F.coalesce(fold(key, FOLDS) == HELD_FOLD, F.lit(False))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: a few windows of each text, spread evenly over it."""
    for batch in slices(batches, "text"):
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            n = max(1, min(WINDOWS, len(text) // LENGTH))
            room = max(0, len(text) - LENGTH)
            starts = [room * i // max(1, n - 1) for i in range(n)]
            rows += [(lang, text[a : a + LENGTH]) for a in starts if text]
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "window"])


def fit(docs: DataFrame, per_language: int = DOCS, steps: int = STEPS) -> tuple[byte_gru.Network | None, list[str]]:
    """A network and its languages, from documents outside the held-out fold.

    Of each language, the ``per_language`` documents of the smallest hashes of
    doc_id and text give WINDOWS windows each. So the sample is bounded for each
    language, and every language is learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy("draw", "doc_id")
    chosen = (
        known.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_language)
        .select("lang", "text")
    )
    rows = sorted(map(tuple, chosen.mapInArrow(_cut, "lang string, window binary").collect()))
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None, []
    windows = np.full((len(rows), LENGTH), byte_gru.PAD, np.int64)
    for row, (_, window) in zip(windows, rows):
        row[: len(window)] = np.frombuffer(window, np.uint8)
    place = {x: i for i, x in enumerate(languages)}
    labels = np.array([place[r[0]] for r in rows])
    return byte_gru.train(windows, labels, len(languages), HIDDEN, steps), languages


def _has_letter(text: bytes) -> bool:
    return text.upper() != text.lower() or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def _label(net: byte_gru.Network, languages: list[str]):
    """mapInArrow function: the language of each text and its probability."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = as_bytes(batch.column("text"))
            sums = byte_gru.position_sums(net, texts, _LETTERS)
            chances = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
            best = chances.argmax(axis=1)
            lettered = [_has_letter(t) for t in texts]
            names = [languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            scores = np.where(lettered, chances[np.arange(len(best)), best], 0.0).clip(0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names), pa.array(scores)],
                [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"],
            )

    return label


def languages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from documents whose crc32(doc_id) modulo 4 is not 2 and whose lang
    is known; a null doc_id may teach. lang_pred is a learned language, or
    ``und`` with score 0 where the text is null, holds no letter, or nothing
    could be learned. Repeated rows are rows like others; other columns are
    left aside. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    net, names = fit(rows)
    keyed = rows.select("doc_id", held_out().alias("held_out"), "text")
    if net is None:
        return keyed.select(
            "doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")
        )
    return keyed.mapInArrow(
        _label(net, names), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_known(docs: DataFrame, least: float | None = None) -> DataFrame:
    """``docs`` without texts of no language: ``und``, or a best score below ``least``.

    ``least`` is LEAST_OVER_CHANCE over the number of languages unless given; where one
    language alone was learned, every text has it, and all texts with a letter stay.
    Without any labelled document outside the held-out fold no language can be
    told; then all texts with a letter stay. All columns are kept, as are
    repeated rows.
    """
    net, names = fit(docs.select(F.col("doc_id").cast("long"), "text", "lang"))
    if least is None:
        least = LEAST_OVER_CHANCE / len(names) if len(names) > 1 else 0.0
    return docs.mapInArrow(_keep(net, names, least), docs.schema)


def _keep(net: byte_gru.Network | None, names: list[str], least: float):
    label = _label(net, names) if net else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, "text"):
            if label is None:
                yield batch.filter(pa.array([_has_letter(t) for t in as_bytes(batch.column("text"))]))
                continue
            told = pa.Table.from_batches(list(label(iter([batch.select(["text"])]))))
            known = pa.array(
                [n != UNDETERMINED and s >= least for n, s in zip(*(told.column(c).to_pylist() for c in ("lang_pred", "score")))]
            )
            yield batch.filter(known)

    return keep
