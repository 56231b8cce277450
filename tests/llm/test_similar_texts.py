"""Similar texts against all pairs, and the recall of the pipeline's near-dedup stage."""

import random

import corpus_pipeline
import numpy as np
import pytest
from plain_similarity import class_of, close_pairs
from pyspark.sql import functions as F

from fieldloom.llm import similar_texts, simhash
from fieldloom.llm.common import documents


def edited(seed, n=150):
    """Texts of many lengths with one to many words changed, and texts that share a part only."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 8, 40, 200, 900]))]
        for _ in range(rng.randrange(6)):
            copy = list(words)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: len(words) // 2] + [f"y{rng.randrange(3000)}" for _ in words]))
    return texts


def linked(spark, texts, tile=similar_texts.TILE):
    table = spark.createDataFrame(list(texts.items()), "text_key long, text string")
    return {(r.a, r.b) for r in similar_texts.similar_links(table, tile=tile).collect()}


@pytest.mark.parametrize("tile", [1024, 4])
def test_links_connect_what_all_pairs_connect(spark, tile):
    odd = [None, "", " \t", "one", "one two", "ONE two", "a b c d e", "z" * 100_000, "a b c d " * 40_000]
    texts = dict(enumerate(odd + edited(1)))
    pairs, found = close_pairs(texts), linked(spark, texts, tile)
    assert found <= pairs and len(pairs) > 100
    own = {k: k for k in texts}
    wanted, got = class_of(own, pairs), class_of(own, found)
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(wanted[a] == wanted[b] for a, b in found)


def test_large_group_of_near_copies_has_few_links(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(1500):
        copy = list(words)
        copy[rng.randrange(300)] = f"x{i}"
        texts[i] = " ".join(copy)
    found = linked(spark, texts, tile=256)
    assert set(class_of({k: k for k in texts}, found).values()) == {0}
    assert len(found) < 300 * len(texts)


def test_sketches_agree_by_the_similarity():
    rng, ratios = np.random.default_rng(3), []
    for _ in range(200):
        both, own = rng.integers(1 << 63, size=800, dtype=np.uint64), rng.integers(1 << 63, size=(2, 100), dtype=np.uint64)
        a, b = (similar_texts.minima(np.concatenate([both, o])) for o in own)
        ratios.append((a == b).mean())
    assert abs(np.mean(ratios) - 0.8) < 0.01
    assert np.mean(np.array(ratios) < similar_texts.LEVELS[-1]) < 0.05


def test_recall_of_the_stage(spark):
    """Of the pairs of sf0.01 at 0.8 or more, 0.9 and more are reduced to one document; others stay."""
    folder = "/root/testdata/sf0.01"
    docs = documents(spark, folder)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    pairs = close_pairs(texts)
    loose = {(a, b) for a, b in pairs if groups[a] != groups[b]}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).select("doc_id").collect()}
    named = class_of(groups, pairs)
    both = sum(a in kept and b in kept for a, b in loose)
    print(f"{len(pairs)} pairs, {len(loose)} beyond SimHash, {both} still there")
    assert both <= 0.1 * len(loose)
    assert kept >= set(named.values()) and len(kept - set(named.values())) <= 0.1 * max(10, len(loose))


def test_stage_without_rows(spark):
    empty = spark.createDataFrame([], "text_key long, text string")
    assert similar_texts.similar_links(empty).count() == 0
    assert similar_texts.similar_links(spark.range(3).select(F.col("id").alias("text_key"), F.lit(None).cast("string").alias("text"))).count() == 0
