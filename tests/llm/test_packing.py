from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from edges import rows, table
from tokenizers import Tokenizer

from holdscope.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(pieces, data, ids, window):
    """Every id of every document lies in one piece, and sequences have no gaps."""
    want = sorted((d is None, d or 0, ids(t).tobytes()) for d, t in data)
    by_doc = defaultdict(list)
    for p in pieces:
        assert p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    got = []
    for d, parts in by_doc.items():
        # Pieces of documents that share an id follow each other by their ids' values.
        left = sorted(parts, key=lambda p: p.start)
        for _, _, all_ids in [w for w in want if w[:2] == (d is None, d or 0)]:
            at, total = 0, len(all_ids) // 4
            while at < total:
                p = next(p for p in left if p.start == at and p.doc_tokens == total and all_ids[4 * at :].startswith(p.ids))
                left.remove(p)
                at += p.length
            got.append((d is None, d or 0, all_ids))
        assert not left
    assert sorted(got) == want
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].fill <= window
    return by_sequence


@pytest.mark.parametrize(("window", "open_windows", "max_gap"), [(2048, 64, 48), (64, 3, 4), (32, 1, 0)])
def test_pieces_cover_all_ids(spark, ids, window, open_windows, max_gap):
    docs = table(spark)
    found = packing.pack(docs, PATH, window=window, open_windows=open_windows, max_gap=max_gap, with_ids=True).collect()
    sequences = check(found, rows(), ids, window)
    filled = sum(p[0].fill for p in sequences.values())
    if window < 2048:
        assert filled > 0.9 * window * len(sequences)


def test_empty_table(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_best_fit_and_fullest_first():
    packer = packing.Packer(0, window=10, open_windows=2, max_gap=3)
    def ids(n):
        return b"\x01\x00\x00\x00" * n
    packer.add(1, ids(6))
    packer.add(2, ids(8))
    packer.add(3, ids(2))  # fits both, the fuller one takes it and is full
    assert [[p[0] for p in d[3]] for d in packer.done] == [[2, 3]]
    packer.add(4, ids(7))
    packer.add(5, ids(9))  # none fits: window of 4 is the fullest, its gap is padded
    assert [[p[0] for p in d[3]] for d in packer.done][1:] == [[4]]


def test_leftover_windows_merge():
    moves = packing.merge_windows([(1, 6), (2, 5), (3, 4), (4, 5)], window=10, keep=0)
    assert {(name, into, base) for name, into, base, _, _ in moves} == {(1, 1, 0), (3, 1, 6), (2, 2, 0), (4, 2, 5)}
    assert not any(still for *_, still in moves)


def test_leftovers_merge_in_rounds(spark, ids, monkeypatch):
    monkeypatch.setattr(packing, "MERGED_TASKS", 2)
    data = [(i, "word " * (i % 7)) for i in range(40)]
    found = packing.pack(table(spark, data, parts=9), PATH, window=64, with_ids=True).collect()
    sequences = check(found, data, ids, 64)
    assert len(sequences) <= -(-sum(p[0].fill for p in sequences.values()) // 64) + 2
