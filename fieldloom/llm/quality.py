"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class is a normal density over transformed statistics of the text. The
moments of all labelled training documents are summed by Spark; covariances are
shrunk to their pool and its mean variance. A score is the logistic of the
difference of the two log densities, Mahalanobis distances by Cholesky factors
that are made once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, fold, slices, written

FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.3
#: Shrinkage of a class covariance to the pool, and of that to its mean variance.
TO_POOL, TO_MEAN = 0.1, 0.02
#: Words that short texts are taken to have more of, all of them average.
PRIOR_WORDS = 8.0

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 sign, 6 space, 7 line end
for _c in range(256):
    _KIND[_c] = (
        1 if chr(_c).islower() and _c < 128 or _c >= 128 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57
        else 4 if chr(_c) in ".,;:?'\"-()" else 7 if _c == 10 else 6 if chr(_c).isspace() else 5
    )

FEATURES = (
    "upper", "digits", "marks", "signs", "spaces", "lines", "word_bytes", "short_words", "distinct_words",
    "top_word", "plain_words", "repeated_lines", "repeated_pairs", "entropy", "doubled_words",
)


def _statistics(text: bytes) -> tuple[float, ...]:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8)
    words = text.split()
    n, size = len(words), max(1, len(text))
    letters = max(1.0, kinds[1] + kinds[2])
    often = Counter(words)
    lines = text.split(b"\n")
    pairs = set(zip(words, words[1:]))
    share = counts[counts > 0] / size
    return (
        n, kinds[2] / letters, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        len(lines) / (n + 1.0), (size - kinds[6] - kinds[7]) / max(1, n),
        sum(c for w, c in often.items() if len(w) <= 3) / max(1, n), len(often) / max(1, n) ** 0.85,
        max(often.values(), default=0) / max(1, n), sum(c for w, c in often.items() if w.isalpha() or w[:-1].isalpha()) / max(1, n),
        1.0 - len(set(lines)) / len(lines), 1.0 - len(pairs) / max(1, n - 1), float(-(share * np.log(share)).sum()),
        sum(map(eq, words, words[1:])) / max(1, n),
    )


def features(texts: list[bytes]) -> np.ndarray:
    """Transformed statistics, one row per text; all within fixed bounds."""
    table = np.array([_statistics(t) for t in texts], float).reshape(-1, len(FEATURES) + 1)
    table[:, 1:7] = np.sqrt(table[:, 1:7])
    table[:, 7] = np.log1p(np.minimum(table[:, 7], 200.0))
    table[:, 9] = np.minimum(table[:, 9], 3.0)
    table[:, [6, 10, 12, 13, 15]] = np.sqrt(np.clip(table[:, [6, 10, 12, 13, 15]], 0.0, 1.0))
    return table


def moments(rows: np.ndarray) -> np.ndarray:
    """Sums by which means and covariances follow: weight, w x, w x x', flat."""
    weight = rows[:, 0] / (rows[:, 0] + PRIOR_WORDS)
    x = rows[:, 1:]
    weighted = x * weight[:, None]
    return np.concatenate(([weight.sum()], weighted.sum(axis=0), (weighted.T @ x).ravel(), [len(rows)]))


@dataclass
class Model:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    constants: list[float]
    average: np.ndarray


def fit_moments(sums: list[np.ndarray]) -> Model:
    """The model from the moments of the labels 0 and 1."""
    d = len(FEATURES)
    means, spreads = [], []
    for s in sums:
        mean = s[1 : d + 1] / max(s[0], 1e-9)
        means.append(mean)
        spreads.append(s[d + 1 : -1].reshape(d, d) / max(s[0], 1e-9) - np.outer(mean, mean))
    total = max(sum(s[0] for s in sums), 1e-9)
    pool = sum(s[0] / total * c for s, c in zip(sums, spreads))
    level = max(float(np.trace(pool)) / d, 1e-6)
    factors, constants = [], []
    for s, spread in zip(sums, spreads):
        shrunk = (1 - TO_POOL) * spread + TO_POOL * pool
        shrunk = (1 - TO_MEAN) * shrunk + TO_MEAN * level * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log((s[-1] + 1) / (sum(x[-1] for x in sums) + 2)) - np.log(np.diag(lower)).sum()))
    average = sum(s[0] / total * m for s, m in zip(sums, means))
    return Model(means, factors, constants, average)


def score(model: Model, rows: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row."""
    weight = (rows[:, 0] / (rows[:, 0] + PRIOR_WORDS))[:, None]
    x = model.means[1] + weight * (rows[:, 1:] - model.means[1])
    logs = [
        c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
        for m, f, c in zip(model.means, model.factors, model.constants)
    ]
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500.0, 500.0)))


_ROW = "doc_id long, held_out boolean, statistics array<double>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        table = features(as_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(table.tolist(), pa.list_(pa.float64()))],
            ["doc_id", "held_out", "statistics"],
        )


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the moments of each label over a partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        table = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(FEATURES) + 1)
        labels = batch.column("quality").to_numpy(zero_copy_only=False)
        for label in (0, 1):
            if (labels == label).any():
                sums[label] = sums.get(label, 0.0) + moments(table[labels == label])
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))],
            ["quality", "sums"],
        )


def _scores(model: Model | None):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(FEATURES) + 1)
            found = score(model, table) if model else np.full(len(table), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"]
            )

    return scores


def fit(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all labelled rows outside the held-out fold; None without any.

    Every label row counts; a label other than 0 and 1 teaches nothing. Spark
    adds the moments up, so the driver gets one row per label and place.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taught = taught.where("quality in (0, 1)")
    known = rows.where(~F.col("held_out")).select("doc_id", "statistics").join(taught, "doc_id")
    sums = (
        known.select("quality", "statistics")
        .mapInArrow(_moments, "quality long, sums array<double>")
        .select("quality", F.posexplode("sums").alias("place", "value"))
        .groupBy("quality", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    d = len(FEATURES)
    table = np.zeros((2, 2 + d + d * d))
    for row in sums:
        table[row.quality, row.place] = row.value
    return fit_moments(list(table)) if sums else None


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    score is the probability of label 1, from the text alone; predicted is 1
    from THRESHOLD on. Learns from ``labels`` (doc_id, quality) of documents
    whose crc32(doc_id) modulo 5 is not 0; a null doc_id has no label. Null and
    empty texts have the score of a text without words, which leans to the
    average of label 1. Without labels every score is 0.5. Repeated rows are
    rows like others; other columns are left aside. An empty table gives an
    empty table.
    """
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_FOLD, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    rows = written(rows.mapInArrow(_features, _ROW), "statistics")
    model = fit(rows, labels)
    scored = rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
