from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from edges import rows, table

from holdscope.llm import piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)

    def encode(text):
        ids = model.encode(text or "")
        return ",".join(map(str, ids)), len(ids), model.decode(ids) if ids else ""

    return encode


def test_rows_as_the_library_does(spark, library):
    found = piece_encoding.encode_decode(table(spark), PATH).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.n_tokens, r.decoded) for r in found)
    assert got == sorted((d is None, d or 0, *library(t)) for d, t in rows())


def test_random_texts_with_a_full_table(library, monkeypatch):
    monkeypatch.setattr(piece_encoding, "TABLE_CHUNKS", 20)
    chunks = piece_encoding.ChunkTable(PATH)
    rnd = random.Random(3)
    signs = ["a", "É", "the", " ", "  ", "\n", "▁", "<0x0A>", "<s>", "\x00", "\t", "中", "😀", "́", "ﬁ", ".", "}\n    "]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12)))
        assert chunks.encode(text) == library(text)
    assert len(chunks) <= 20


def test_empty_table(spark):
    assert piece_encoding.encode_decode(table(spark, []), PATH).count() == 0


def test_refuses_what_is_no_model():
    with pytest.raises((OSError, RuntimeError)):
        piece_encoding.ChunkTable("/nonexistent.model")
