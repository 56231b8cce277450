"""What a worker process keeps between the steps of the pipeline."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from fieldloom.llm import byte_gru, common, decontaminate, langid, simhash, tokenizing


def batch():
    return iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words of a text"])], ["doc_id", "text"])])


def test_a_process_keeps_what_one_step_needs():
    path = public_tokenizers.path("word_bpe_49k.json")
    before = tokenizing.word_encoder(path, "<u2")
    assert tokenizing.word_encoder(path, "<u2") is before and tokenizing.tokenizer(path) is tokenizing.tokenizer(path)
    list(decontaminate._windows("doc_id", (8,), None)(batch()))
    assert list(common._KEPT) == ["templates"]
    reader = common._KEPT["templates"]["reader"]
    list(decontaminate._windows("doc_id", (8,), None)(batch()))
    assert common._KEPT["templates"]["reader"] is reader
    for step in (simhash._fingerprints(4), langid._keep(byte_gru.new_network(2, 2, 1), ["de", "en"], 0.0)):
        again = tokenizing.word_encoder(path, "<u2")
        assert again is not before
        list(step(batch()))
        assert not any(common._KEPT.values())
    assert again.encode([b"some words"]) == [np.array(tokenizing.encode_batch(path, [b"some words"])[0], "<u2").tobytes()]
