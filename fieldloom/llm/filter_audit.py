"""Filter interaction audit: what five text filters remove, in each of their orders.

Which documents fail which filters is all that an order can tell, so a part of
the corpus is 32 counts: its documents by the set of filters they fail. The
removal game of a part gives each coalition of filters the documents that fail
one of them. Differences of coalitions are the steps of the orders, and the
potential of Hart and Mas-Colell ("Potential, value and consistency", 1989),
computed once per coalition, gives each filter's Shapley value as the grand
potential minus the potential without it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, distinct words and capitals in percent, symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
#: The filter that needs other documents: copies of a text with a smaller doc_id.
COPY_BIT = 1 << FILTERS.index("E")


def own_failures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, part, digest, failed.

    failed has bit 0 to 3 set where the text alone fails filter A to D; digest
    is the SHA-256 of the text. Null texts count as empty, null sources as ''.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("capitals"),
        F.length(text).alias("code_points"),
        text.rlike(SYMBOLS).alias("symbols"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    counted = read.withColumns(
        {"n_words": F.size("words").cast("long"), "n_distinct": F.size(F.array_distinct("words")).cast("long")}
    )
    failing = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("capitals").cast("long") > MOST_CAPITALS * F.col("code_points").cast("long"),
        F.col("symbols"),
    )
    failed = sum((f.cast("int") * F.lit(1 << i) for i, f in enumerate(failing)), F.lit(0))
    return counted.select("doc_id", "part", "digest", failed.alias("failed"))


def _marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, as any label of their doc_id says."""

    def says(column: str) -> Column:
        return F.bool_or(F.coalesce(F.col(column) == 1, F.lit(False)))

    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic")
        .where("id is not null")
        .groupBy("id")
        .agg(says("quality").alias("good"), says("toxic").alias("toxic"))
        .withColumn("salt", F.lit(0).cast("long"))
    )
    # Rows without an id match no label; the salt keeps them from meeting in one task.
    salted = rows.withColumn(
        "salt", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    )
    on = (salted.doc_id == marks.id) & (salted.salt == marks.salt)
    return salted.join(marks, on, "left").select(
        *rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    )


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents of a part by the set of filters they fail.

    Copies are told by their digest, table-wide. A group of copies is summed up
    per part before its smallest doc_id is sought, so no group meets in one task.
    """
    alike = ["digest", "part", "failed", "good", "toxic"]
    rows = _marked(own_failures(docs), labels).groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("named"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.col("named") - F.coalesce(firsts, F.lit(0))
    told = groups.withColumn("first", first).select(*alike, "n", copies.alias("copies"))
    kinds = F.array(
        F.struct(F.col("failed").alias("failed"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("failed") + COPY_BIT).alias("failed"), F.col("copies").alias("n")),
    )
    split = told.select("part", "good", "toxic", F.explode(kinds).alias("kind")).select(
        "part", "good", "toxic", "kind.*"
    )
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def removed_by(counts: np.ndarray) -> np.ndarray:
    """The removal game: documents that fail a filter of each coalition, from counts by failures."""
    sets = np.arange(len(counts))
    return np.array([counts[sets & s > 0].sum() for s in sets.tolist()])


def potentials(worth: Sequence[int], players: int) -> list[int]:
    """``players``! times the potential of each coalition.

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|, P of none is 0. The
    factor makes all of them whole numbers.
    """
    found = [0] * (1 << players)
    for s in range(1, 1 << players):
        without = [s ^ (1 << i) for i in range(players) if s >> i & 1]
        found[s] = (factorial(players) * int(worth[s]) + sum(found[t] for t in without)) // len(without)
    return found


AUDIT_ROW = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
_ARROW = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def _audit(filters: str):
    """mapInArrow function: parts with their counts to one row per order and step."""
    players = len(filters)
    orders = list(permutations(range(players)))

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((3, 1 << players), np.int64)
                for c in row["counts"]:
                    counts[:, c["failed"]] = c["n"], c["good"], c["toxic"]
                total = int(counts[0].sum())
                v, good, toxic = (removed_by(c).tolist() for c in counts)
                potential = potentials(v, players)
                every = (1 << players) - 1
                shapley = [potential[every] - potential[every ^ (1 << i)] for i in range(players)]
                out = []
                for order in orders:
                    name, before = "".join(filters[i] for i in order), 0
                    for step, i in enumerate(order, 1):
                        after = before | 1 << i
                        removed = v[after] - v[before]
                        out.append(
                            (row["part"], name, step, total - v[after], removed, v[1 << i] - removed,
                             int(counts[0][1 << i]), good[after] - good[before], toxic[after] - toxic[before], shapley[i])
                        )
                        before = after
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW
                )

    return audit


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, failed, n, good, toxic) to one row per part, order of filters and step.

    ``failed`` is a set of ``filters`` as bits; a part has at most two to their
    number of such rows.
    """
    listed = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("counts"))
    return listed.mapInArrow(_audit(filters), AUDIT_ROW)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over ``docs`` (doc_id, text, source), in all 120 orders.

    A: under 50 words. B: less than 65 % of the words are distinct. C: more than
    5 % of the code points are capitals A-Z. D: holds one of ``#$%&*|``. E: the
    text is that of a smaller doc_id. One row per part (source; null is ''),
    filter_order and step, with counts within the part: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, and shapley (removals summed
    over all orders). ``labels`` (doc_id, quality, toxic) may repeat a doc_id:
    any 1 counts, once. Null and empty texts fail A alone, and E where another
    empty text has a smaller id. Rows of one doc_id are all counted, and are no
    copies of each other; rows without a doc_id are never copies, nor make any.
    Other columns are left aside. An empty table gives an empty table.
    """
    return interactions(failure_counts(docs, labels))


ORACLE = r"""
with texts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels where doc_id is not null group by doc_id
), failing as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    len(words) < 50 as a,
    100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) as c,
    regexp_matches(text, '[#$%&*|]') as d,
    coalesce(t.doc_id > min(t.doc_id) over (partition by text), false) as e
  from texts t left join marks m on t.doc_id = m.doc_id
), flat as (
  select part, good, toxic, list_filter(
    ['A', 'B', 'C', 'D', 'E'], lambda f, i: [a, b, c, d, e][i]) as failed
  from failing
), kinds as (
  select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from flat group by part, failed
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
  select [p.l, q.l, r.l, s.l, t.l] as fs from letters p, letters q, letters r, letters s, letters t
  where len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5
), fates as (
  select part, fs, failed, n, good, toxic,
    coalesce(list_min(list_transform(failed, lambda f: list_position(fs, f))), 6) as gone
  from kinds, orders
), steps as (
  select part, array_to_string(fs, '') as filter_order, step, fs[step] as f,
    sum(case when gone > step then n else 0 end) as kept,
    sum(case when gone = step then n else 0 end) as removed,
    sum(case when gone < step and list_contains(failed, fs[step]) then n else 0 end) as redundant,
    sum(case when failed = [fs[step]] then n else 0 end) as unique_fails,
    sum(case when gone = step then good else 0 end) as good_lost,
    sum(case when gone = step then toxic else 0 end) as toxic_lost
  from fates, (select unnest([1, 2, 3, 4, 5]) as step) group by part, fs, step
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from steps
"""
