from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from edges import rows, table
from tokenizers import Tokenizer

from holdscope.llm import token_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("total", [1, 2, 3, 7, 100, 4097])
def test_permutation(total):
    slots = token_shards.feistel(np.arange(total), total, 99)
    assert sorted(slots.tolist()) == list(range(total))
    assert (token_shards.unfeistel(slots, total, 99) == np.arange(total)).all()
    assert total < 100 or (slots != token_shards.feistel(np.arange(total), total, 98)).any()


def test_round_trip(spark, tmp_path):
    manifest, path = token_shards.write_shards(table(spark), PATH, path=f"{tmp_path}/s", length=64, shard_sequences=50)
    m = manifest.toPandas().sort_values("slot")
    read = token_shards.read_shards(spark, path, 64, 50).toPandas().sort_values("slot")
    assert m.slot.tolist() == read.slot.tolist() == list(range(len(m)))
    assert (m.shard == m.slot // 50).all() and (m.offset == m.slot % 50 * 129).all()
    for ids, n, crc in zip(read.ids, m.n_tokens, m.ids_crc32, strict=True):
        assert zlib.crc32(np.array(ids[:n], "<u4").tobytes()) == crc and not any(ids[n:])
    tokenizer = Tokenizer.from_file(PATH)
    want = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows())
    assert m.n_tokens.sum() == want
    later = token_shards.read_shards(spark, path, 64, 50, first=75).toPandas()
    assert later.slot.min() == 75 and len(later) == len(m) - 75


def test_resumed_read_opens_no_earlier_shard(spark, tmp_path):
    data = [(i, " ".join(f"w{i} x{j}" for j in range(80))) for i in range(60)]
    manifest, path = token_shards.write_shards(table(spark, data), PATH, path=f"{tmp_path}/r", length=64, shard_sequences=50)
    total = manifest.count()
    assert total > 150
    for broken in (f"{path}/shard=0", f"{path}/shard=1"):
        for file in Path(broken).glob("part-*"):
            file.unlink()
            file.symlink_to(f"{tmp_path}/nowhere")
    later = token_shards.read_shards(spark, path, 64, 50, first=110).select("slot").collect()
    assert sorted(r.slot for r in later) == list(range(110, total))


def test_ids_by_brute_force(spark, tmp_path):
    """All ids in slot order, put back in reading order, are those of the documents of each task one after another."""
    data = [(i, t) for i, t in enumerate(t for _, t in rows())]
    docs = table(spark, data, parts=1).orderBy("doc_id").coalesce(1)
    manifest, path = token_shards.write_shards(docs, PATH, path=f"{tmp_path}/b", length=64, shard_sequences=50)
    read = {r.slot: r.ids for r in token_shards.read_shards(spark, path, 64, 50).collect()}
    told = {r.slot: r for r in manifest.collect()}
    tokenizer = Tokenizer.from_file(PATH)
    want = [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in data]
    flat = [i for _, ids in want for i in ids]
    first = [(d, n) for d, ids in want for n in range(len(ids))]
    slots = token_shards.feistel(np.arange(len(read)), len(read), token_shards.KEY).tolist()
    for n, slot in enumerate(slots):
        part = flat[64 * n : 64 * n + 64]
        assert read[slot][: len(part)] == part and told[slot].n_tokens == len(part)
        assert (told[slot].doc_id, told[slot].start) == first[64 * n]


def test_same_key_same_slots(spark, tmp_path):
    docs = table(spark)
    first = token_shards.sequences(docs, PATH, "doc_id", "text", 64)
    begin, total = token_shards.counted(first)
    a, b = (token_shards.with_slots(first, begin, total, 5, 64, 50) for _ in range(2))
    columns = ["slot", "ids_crc32"]
    assert sorted(a.select(columns).collect()) == sorted(b.select(columns).collect()) and a.count() == total


def test_empty_table(spark, tmp_path):
    manifest, path = token_shards.write_shards(table(spark, []), PATH, path=f"{tmp_path}/e")
    assert manifest.count() == 0
