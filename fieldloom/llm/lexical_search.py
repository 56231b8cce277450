"""Ranked lexical search by dense blocked matrix products.

Items are the queries, documents are ranked for each. One pass over the texts
keeps, per document, the terms that items hold; a second pass over these tiles
scores them. A tile of items has a compact vocabulary of its own: its weights
are a dense matrix, a tile of documents is a dense matrix of impacts over the
same vocabulary, and their product holds the scores of all pairs. Weights and
impacts are integers, and a vocabulary tile ends where a partial sum could
reach 2^53, so products in double precision are exact; sums over vocabulary
tiles are 64-bit integers. Each tile keeps its best documents per item in the
total order (score, then doc_id), so ties never depend on the tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import as_bytes, slices, written

TOP = 50
#: Items and distinct terms of one block; each block reads the documents anew.
ITEMS, VOCABULARY = 4096, 200_000
#: Sizes of the tiles: items, terms of their vocabulary, documents, terms of these.
ITEM_TILE, TERM_TILE, DOC_TILE, ENTRIES = 64, 2048, 512, 1 << 20
#: Groups in which the best documents of an item meet before they meet in one.
FAN_IN = 256
#: An impact is below this; products with weights are summed up below EXACT.
MOST_IMPACT, EXACT = 1_000_000, 1 << 53

#: Bytes of a term are A-Z (lower-cased), a-z, 0-9 and all beyond ASCII; others divide terms.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LAST = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


_TILE = (
    "n_docs long, n_terms long, docs array<long>, sizes array<long>, ends array<int>, terms array<int>, tfs array<long>"
)
_TILE_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
     ("ends", pa.list_(pa.int32())), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))]
)


def _tiles(place: dict[bytes, int]):
    """mapInArrow function: texts to tiles of documents with their terms of the vocabulary ``place``."""

    def tile(n_docs: int, n_terms: int, held: list) -> pa.RecordBatch:
        docs, sizes, found, tfs = zip(*held) if held else ((), (), (), ())
        ends = np.cumsum([len(x) for x in found], dtype=np.int32)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, tfs)]
        columns = [[n_docs], [n_terms], [list(docs)], [list(sizes)], [ends], [flat[0].astype(np.int32)], [flat[1]]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TILE_ARROW.types)], schema=_TILE_ARROW)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, n_terms, held, entries = 0, 0, [], 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                words = terms(text)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                found, tfs = np.unique(at[at >= 0], return_counts=True)
                if not len(found):
                    continue
                held.append((doc_id, len(words), found, tfs))
                entries += len(found)
                if len(held) >= DOC_TILE or entries >= ENTRIES:
                    yield tile(n_docs, n_terms, held)
                    n_docs, n_terms, held, entries = 0, 0, [], 0
        if n_docs:
            yield tile(n_docs, n_terms, held)

    return tiles


def item_tiles(
    items: list[np.ndarray], weights: np.ndarray, item_tile: int = ITEM_TILE, term_tile: int = TERM_TILE
) -> list[tuple[np.ndarray, list[tuple[np.ndarray, list[np.ndarray]]]]]:
    """Tiles of items, each with its vocabulary tiles: (item numbers, [(terms, [places in terms, per item])]).

    Items with like terms need not stand together; terms of weight zero are left
    out. A vocabulary tile ends after ``term_tile`` terms, or where one item's
    weights times the largest impact could reach 2^53.
    """
    tiles = []
    for at in range(0, len(items), item_tile):
        numbers = np.arange(at, min(at + item_tile, len(items)))
        own = [items[i][weights[items[i]] > 0] for i in numbers]
        vocabulary = np.unique(np.concatenate(own))
        cuts, start = [], 0
        while start < len(vocabulary):
            end = min(start + term_tile, len(vocabulary))
            # The whole tile's weights bound those of each item.
            sums = np.cumsum(weights[vocabulary[start:end]]) * MOST_IMPACT
            end = start + max(1, int(np.searchsorted(sums, EXACT)))
            some = vocabulary[start:end]
            cuts.append((some, [np.flatnonzero(np.isin(some, x, assume_unique=True)) for x in own]))
            start = end
        tiles.append((numbers, cuts))
    return tiles


class _Best:
    """The ``top`` best (score, doc_id) of each item, in a total order."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.held = [np.zeros(0, np.int64)] * 4  # item, score, unnamed, doc_id
        self.new: list[tuple[np.ndarray, ...]] = []
        self.many = 0

    def offer(self, numbers: np.ndarray, scores: np.ndarray, docs: np.ndarray, unnamed: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[numbers][:, None])
        if len(item):
            self.new.append((numbers[item], scores[item, doc], unnamed[doc], docs[doc]))
            self.many += len(item)
            if self.many > 2 * self.top * len(self.least):
                self.settle()

    def settle(self) -> None:
        item, score, unnamed, doc = (np.concatenate(x) for x in zip(self.held, *self.new))
        order = np.lexsort((doc, unnamed, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)  # where the item begins
        keep = np.arange(len(item)) - first < self.top
        self.held = [x[order][keep] for x in (score, unnamed, doc)]
        self.held.insert(0, item[keep])
        # An item with ``top`` documents takes no lower score any more.
        full = np.flatnonzero(np.arange(len(item)) - first == self.top - 1)
        self.least[item[full]] = score[order][full]
        self.new, self.many = [], 0


def _score(tiles: list, weights: np.ndarray, n_docs: int, n_terms: int, items: int, top: int):
    """mapInArrow function: tiles of documents to the best documents of each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, column = _Best(items, top), np.full(len(weights), -1)
        dense = [
            (numbers, [(some, _matrix(places, weights[some])) for some, places in cuts]) for numbers, cuts in tiles
        ]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, ends, found, tfs = (
                    batch.column(c)[row].values for c in ("docs", "sizes", "ends", "terms", "tfs")
                )
                if not len(ids):
                    continue
                docs = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
                unnamed = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ends, found, tf = ends.to_numpy(), found.to_numpy(), tfs.to_numpy()
                of = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
                m = 50 + 50 * sizes.to_numpy() * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[of])
                for numbers, cuts in dense:
                    scores = np.zeros((len(numbers), len(docs)), np.int64)
                    for some, matrix in cuts:
                        column[some] = np.arange(len(some))
                        at = column[found]
                        held = np.flatnonzero(at >= 0)
                        impacts = np.zeros((len(some), len(docs)))
                        impacts[at[held], of[held]] = impact[held]
                        scores += (matrix @ impacts).astype(np.int64)
                        column[some] = -1
                    best.offer(numbers, scores, docs, unnamed)
        best.settle()
        item, points, unnamed, doc = best.held
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(doc, mask=unnamed > 0), pa.array(points)], ["item", "doc_id", "score"]
            )

    return score


def _matrix(places: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), len(weights)))
    for row, at in zip(out, places):
        row[at] = weights[at]
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of at most ITEMS and VOCABULARY terms (one item at least)."""
    texts = F.concat_ws("\n", F.collect_list("text"))
    merged = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    merged = merged.groupBy("item_id").agg(texts.alias("text")).orderBy("item_id")
    block, known = [], set()
    for row in merged.toLocalIterator():
        own = sorted(set(terms(row.text.encode())))
        if block and (len(block) >= ITEMS or len(known.union(own)) > VOCABULARY):
            yield block
            block, known = [], set()
        block.append((row.item_id, own))
        known.update(own)
    if block:
        yield block


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame | None:
    spark = docs.sparkSession
    place = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
    if not place:
        return None
    tiles = written(docs.mapInArrow(_tiles(place), _TILE), "tiles")
    total = tiles.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    if not total.docs:
        return None
    df = np.zeros(len(place), np.int64)
    counted = tiles.select(F.explode("terms").alias("term")).groupBy("term").count()
    for row in counted.toLocalIterator():  # one row at most for each term of the block
        df[row.term] = row["count"]
    weights = np.array(
        [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64
    )
    held = [np.array([place[t] for t in own], np.int64) for _, own in block]
    scored = tiles.mapInArrow(
        _score(item_tiles(held, weights), weights, total.docs, total.terms, len(block), top),
        "item long, doc_id long, score long",
    )
    # The best of each task meet in groups of tasks first.
    salted = scored.withColumn("group", F.spark_partition_id() % FAN_IN)
    best = _ranked(salted, ["item", "group"], top).drop("rank")
    names = spark.createDataFrame(
        [Row(item=i, item_id=item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long"
    )
    return _ranked(best, ["item"], top).join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Columns item_id, rank (int, from 1), doc_id, score (long). Terms are runs of
    letters and digits of ASCII and of all characters beyond it; A-Z count as
    a-z. A term in n of N documents with terms weighs floor(1000 ln((2N+2)/(2n+1)));
    a document holds it with the impact 10^9 tf div (1000 tf + 20 m), m growing
    with its length. Equal scores are ranked by doc_id, null last; only scores
    above 0 are listed. Rows of one item_id (null is one, too) are one item of
    all their terms; rows of one doc_id are ranked apart. Null and empty texts
    have no terms. Other columns are left aside. Without documents or items the
    result is empty. Items are taken in blocks of bounded size, one pass over the
    documents for each block.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items):
        found = _search_block(rows, block, top)
        out = out if found is None else out.union(found)
    return out


ORACLE = r"""
with lowered as (
  select doc_id, row_number() over () as row_no,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), sized as (select doc_id, row_no, terms, len(terms)::bigint as n from lowered where len(terms) > 0
), totals as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sized
), item_terms as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), held as (
  select row_no, doc_id, n, term, count(*)::bigint as tf
  from (select row_no, doc_id, n, unnest(terms) as term from sized)
  where term in (select term from item_terms) group by all
), weights as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w
  from held, totals group by term, n_docs
), scored as (
  select item_id, row_no, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from item_terms join held using (term) join weights using (term), totals
  group by item_id, row_no, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
