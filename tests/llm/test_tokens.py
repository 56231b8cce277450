"""Token files and counts against the tokenizer library itself."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import token_counts, token_files, tokenizing
from fieldloom.llm.common import documents

SMALL = "/root/testdata/sf0.001"
WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))

TEXTS = [
    None, "", " ", "\n\t ", "Hello  World!\n it's 12 a.b, c--d", "Ärger İx é É ﬁ K", "　a b  \x1c c\x85d",
    "<|endoftext|> x <|endoftext|>  y<|startoftext|> ", "don't  <|", "a" * 3000 + " b", "中文 字\n\n 日本",
    "word, " * 20_000, "tie", "tie",
]
ODD = [{"doc_id": 50 - i, "text": t} for i, t in enumerate(TEXTS)]
ODD += [{"doc_id": None, "text": "no id"}, {"doc_id": 38, "text": "tie"}, {"doc_id": 38, "text": "another"}]


def library(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def expected_files(rows, ids):
    ordered = sorted(zip(rows, ids), key=lambda x: (x[0] is not None, x[0] or 0))
    starts = np.cumsum([0] + [len(i) + 1 for _, i in ordered])
    return [
        (d, int(s), len(i) + 1, zlib.crc32(np.array(i + [1], "<u4").tobytes()))
        for (d, i), s in zip(ordered, starts)
    ]


def test_token_files_of_a_whole_table(spark):
    docs = documents(spark, SMALL)
    rows = docs.select("doc_id", "text").collect()
    found = token_files.token_digest(docs, WORDS).collect()
    ids = library(WORDS, [r.text for r in rows])
    assert sorted(map(tuple, found)) == expected_files([r.doc_id for r in rows], ids)


def test_token_files_of_odd_texts(make, folder):
    found = token_files.token_digest(make(ODD), WORDS, folder + "/x").collect()
    ids = library(WORDS, [r["text"] for r in ODD])
    lengths = sorted(map(tuple, found), key=lambda r: r[1])
    assert [r[0] for r in lengths] == sorted((r["doc_id"] for r in ODD), key=lambda d: (d is not None, d or 0))
    assert all(a[1] + a[2] == b[1] for a, b in zip(lengths, lengths[1:]))
    by_id = lambda rows: sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert by_id(found) == by_id(expected_files([r["doc_id"] for r in ODD], ids))


def test_parts_are_contiguous_and_mapped(spark, make, folder):
    parts = token_files.write_tokens(make([{"doc_id": i, "text": "a b " * i} for i in range(300)]), WORDS, folder + "/y")
    rows = sorted(parts.collect())
    assert all(a.base + a.n_ids == b.base for a, b in zip(rows, rows[1:]))
    ids, offsets, docs = token_files.open_part(folder + "/y", rows[-1].stem, rows[-1].width)
    assert isinstance(ids, np.memmap) and ids.dtype == np.uint16 and offsets.dtype == np.uint64
    assert offsets[0] == rows[-1].base and offsets[-1] == rows[-1].base + len(ids)
    assert len(docs) == len(offsets) - 1


@pytest.mark.parametrize("group,block", [(24 << 20, 16 << 20), (1 << 14, 100_000)])
def test_token_counts(spark, make, group, block, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP_BYTES", group)
    rows = ODD + [
        {"doc_id": 1000 + r.doc_id, "text": r.text} for r in documents(spark, SMALL).select("doc_id", "text").collect()
    ]
    found = token_counts.token_counts(make(rows), BYTES, block_bytes=block).collect()
    ids = library(BYTES, [r["text"] for r in rows])
    expected = [(r["doc_id"], len((r["text"] or "").encode()), len(i), len(i) > 512) for r, i in zip(rows, ids)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_pre_tokens_are_the_library_s():
    """Random texts of spaces, marks and letters: the cuts of the library's own pre-tokenizer, and its counts."""
    cut, opened = tokenizing.PreTokens(BYTES), Tokenizer.from_file(BYTES)
    alphabet = [*"aB ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "'s", "'", "12", ",", "!?", "é", "中", "\r\n", "\u200b", "don't"]
    rng = random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        counts = cut(text.encode())
        spans = [text[a:b].encode() for _, (a, b) in opened.pre_tokenizer.pre_tokenize_str(text)]
        assert counts == Counter(spans), text
        pieces = cut.piece_counts(list(counts))
        assert sum(p * n for p, n in zip(pieces, counts.values())) == len(opened.encode(text, add_special_tokens=False).ids)
    assert cut('said: "well,'.encode()) == Counter([b"said", b":", b' "', b"well", b","])
    assert len(cut(("word " * 1000 + "\xa0 end").encode())) < 6


def test_tokenizers_of_another_family(make, folder):
    """Files of a tokenizer that keeps case, and counts of one that does not cut by bytes."""
    assert tokenizing.WordEncoder(WORDS, "<u2").wordwise and not tokenizing.WordEncoder(BYTES, "<u2").wordwise
    found = token_files.token_digest(make(ODD), BYTES, folder + "/other").collect()
    expected = expected_files([r["doc_id"] for r in ODD], library(BYTES, [r["text"] for r in ODD]))
    by_id = lambda rows: sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert by_id(found) == by_id(expected)
    counted = token_counts.token_counts(make(ODD), WORDS).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in counted) == sorted(
        (str(r["doc_id"]), len(i)) for r, i in zip(ODD, library(WORDS, [r["text"] for r in ODD]))
    )


def test_folders_in_every_form(spark, make, folder):
    docs = make([{"doc_id": i, "text": "a b " * i} for i in range(5)])
    forms = [f"{folder}/a", f"file:{folder}/b", f"file://{folder}/c"]
    rows = [sorted(map(tuple, token_files.token_digest(docs, WORDS, f).collect())) for f in forms]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 5
    # The folder that setCheckpointDir makes is told as file:/...
    spark.sparkContext.setCheckpointDir(folder)
    told = spark.sparkContext.getCheckpointDir()
    assert told.startswith("file:/") and token_files.token_digest(docs, WORDS, told + "/d").count() == 5


def test_empty_tables(make, folder):
    assert token_files.token_digest(make([]), WORDS, folder + "/z").count() == 0
    assert token_counts.token_counts(make([]), BYTES).count() == 0
