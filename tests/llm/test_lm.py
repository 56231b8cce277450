"""Language-model scores against a plain backoff automaton."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import ngram_lm
from fieldloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return bytes(text or "", "utf8").lower().split() + ["end"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Automaton:
    """States with arcs and one failure arc each, walked word by word."""

    def __init__(self, texts, discount=0.75):
        words = Counter(w for t in texts for w in t)
        total, kinds = sum(words.values()), len(words)
        self.root = lambda w: (words[w] + 0.1) / (total + 0.1 * (kinds + 1))
        self.words, self.total = words, total
        after = defaultdict(Counter)
        for t in texts:
            for h, w in zip(["start", *t], t):
                after[h][w] += 1
        self.failure = {h: discount * len(c) / c.total() for h, c in after.items()}
        self.arcs = {
            h: {w: (n - discount) / c.total() + self.failure[h] * self.root(w) for w, n in c.items()}
            for h, c in after.items()
        }

    def walk(self, text):
        state, score = "start", 0.0
        for w in text:
            if state in self.arcs and w in self.arcs[state]:
                score += math.log10(self.arcs[state][w])
            elif state in self.arcs:
                score += math.log10(self.failure[state]) + math.log10(self.root(w))
            else:
                score += math.log10(self.root(w))
            state = w
        return score


def check(found, rows):
    model = Automaton([tokens(t) for d, t in rows if not held(d)])
    expected = []
    for d, t in rows:
        ws = tokens(t)
        base = sum(math.log10(model.root(w)) for w in ws)
        known = sum(model.words[w] > 0 for w in ws)
        expected.append((str(d), held(d), len(ws), known, model.total, base, model.walk(ws)))
    assert len(found) == len(expected)
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for mine, theirs in zip(sorted([(str(r[0]), *r[1:]) for r in found], key=key), sorted(expected, key=key)):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-9)


@pytest.mark.parametrize("keys,block", [(1_500_000, 16 << 20), (2_000, 50_000)])
def test_scores_of_a_whole_table(spark, keys, block, monkeypatch):
    monkeypatch.setattr(ngram_lm, "GROUP_KEYS", keys)
    docs = documents(spark, SMALL)
    found = ngram_lm.lm_scores(docs, block_bytes=block).collect()
    check(found, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(make):
    rows = [(1, ""), (2, None), (3, " "), (4, "a b A B"), (4, "a b A B"), (None, "a ü Ü"), (30, "new a b new"),
            (7, "x " * 50_000)] + [(i, "same words again") for i in range(40, 70)]
    found = ngram_lm.lm_scores(make([{"doc_id": d, "text": t} for d, t in rows])).collect()
    check(found, rows)


def test_no_training_rows_and_empty_table(make):
    out = next(i for i in range(100) if held(i))
    rows = ngram_lm.lm_scores(make([{"doc_id": out, "text": "a b"}])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in rows] == [(3, 0, 0, 0.0)]
    assert ngram_lm.lm_scores(make([])).count() == 0
