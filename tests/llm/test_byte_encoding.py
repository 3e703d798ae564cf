"""Byte-level BPE against the tokenizer library, row by row, and its appends and edits."""

from __future__ import annotations

import random

import edges
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from holdscope.llm import byte_encoding, queries
from holdscope.llm.byte_encoding import ByteTable, EditedText, Prefixes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "  ab\n\t'slreve12.,é中文ñ\x1c\x85  zthean"


@pytest.fixture(scope="module")
def table():
    return ByteTable(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(table):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table.ranks.rank, special_tokens={})


def _ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_characters(table, library):
    texts = [f"a{chr(c)}1 {chr(c)} b {chr(c) * 2}\n{chr(c)}c" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 50_000):
        some = texts[at : at + 50_000]
        assert [_ids(e) for e in table.encode(some)] == library.encode_ordinary_batch(some, num_threads=4)


def test_any_bytes(table, library):
    rnd = random.Random(4)
    strings = [bytes(rnd.choice(b"etaoinshrdlu \xc3\xa9\xa8\x00\xff") for _ in range(rnd.randint(1, 60))) for _ in range(5000)]
    wanted = [library._core_bpe.encode_single_piece(s) for s in strings]
    assert [Prefixes(table.ranks, s).ids() for s in strings] == wanted
    ids, counts = table.many.ids(strings)
    found = [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])]
    assert [f for f, s in zip(found, strings, strict=True) if s not in table.ranks.rank] == [
        w for w, s in zip(wanted, strings, strict=True) if s not in table.ranks.rank
    ]


def test_prefixes_appends_and_edits(table, library):
    rnd = random.Random(7)
    whole = "internationalization".encode()
    growing = Prefixes(table.ranks)
    for i in range(len(whole)):
        growing.append(whole[i : i + 1])
        assert growing.ids() == Prefixes(table.ranks, whole).ids(i + 1) == library._core_bpe.encode_single_piece(whole[: i + 1])
    for _ in range(400):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30)))
        edited = EditedText(table.ranks, PATTERN, text)
        for _ in range(5):
            a = rnd.randint(0, len(text))
            b, new = rnd.randint(a, min(len(text), a + 3)), "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 4)))
            edited.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert edited.text == text and edited.ids() == library.encode_ordinary(text)
        edited.append("'ll go")
        assert edited.ids() == library.encode_ordinary(text + "'ll go")


def test_small_table_gives_the_same(table, library, monkeypatch):
    monkeypatch.setattr(byte_encoding, "TABLE_CHUNKS", 40)
    monkeypatch.setattr(byte_encoding, "PIECES", 7)
    rnd = random.Random(9)
    small = ByteTable(PATH, PATTERN)
    for _ in range(30):
        texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 120))) for _ in range(8)]
        packed = small.encode(texts)
        assert [_ids(p) for p in packed] == [library.encode_ordinary(t) for t in texts]
        assert list(small.decode(packed)) == [t.encode() for t in texts]


def test_edge_rows(spark, library):
    found = byte_encoding.encode_decode(edges.table(spark), PATH, PATTERN).collect()
    got = sorted((r["doc_id"] or 0, _ids(bytes(r["ids"])), bytes(r["decoded"])) for r in found)
    wanted = [(i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in edges.rows()]
    assert got == sorted(wanted)
    assert byte_encoding.encode_decode(edges.table(spark).limit(0), PATH, PATTERN).collect() == []


def test_query_against_the_library(spark, library):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.QUERIES["op12_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    wanted = set()
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        decoded = library.decode_bytes(ids)
        wanted.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == wanted
