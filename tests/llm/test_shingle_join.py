from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from edges import left, rows, table
from pyspark.sql import functions as F

from holdscope.llm import components, shingle_join, simhash_trie


def shingles(text: str | None, words: int = 5) -> frozenset[bytes]:
    parts = [w.lower() for w in (text or "").encode().split()]
    if len(parts) <= words:
        return frozenset([b" ".join(parts)] if parts else [])
    return frozenset(b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1))


def brute(texts: list[str | None]) -> list[int]:
    """The first text that each text reaches over pairs of Jaccard similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(seed: int = 3) -> list[tuple[int, str]]:
    """Texts with copies that have more and more words replaced, inside a large group and a chain too."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    common = " ".join(word() for _ in range(20))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(3, 150))]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
        out.append(" ".join(base) + " " + common)
    long = [word() for _ in range(300)]
    for _ in range(60):
        copy = list(long)
        for _ in range(rnd.randint(1, 4)):
            copy[rnd.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    for _ in range(20):
        for k in range(0, 3):
            long[rnd.randrange(100 * k, 100 * k + 100)] = word()
        out.append(" ".join(long))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "looked_at", "block", "token_rows"), [(3, 64, 1 << 21, 4096), (4, 1, 50, 3)])
def test_near_copies_against_all_pairs(spark, monkeypatch, seed, looked_at, block, token_rows):
    monkeypatch.setattr(shingle_join, "TOKEN_ROWS", token_rows)
    monkeypatch.setattr(shingle_join, "LOOKED_AT", looked_at)
    monkeypatch.setattr(shingle_join, "BLOCK_PAIRS", block)
    data = near_copies(seed)
    want = brute([t for _, t in data])
    found = shingle_join.near_groups(table(spark, data)).collect()
    least: dict[int, int] = {}
    for r in found:
        least[r.root] = min(r.doc_id, least.get(r.root, r.doc_id))
    assert {r.doc_id: least[r.root] for r in found} == dict(enumerate(want))


def test_fingerprints_propose_near_copies(spark):
    """Most near copies are linked through the pairs of neighbouring fingerprints alone."""
    data = near_copies()
    want = brute([t for _, t in data])
    names = [shingle_join.set_name(shingle_join.shingle_set(t.encode())) for _, t in data]
    known = spark.sparkContext.broadcast(np.empty(0, np.int64))
    texts = table(spark, data).select(F.col("doc_id").cast("bigint"), F.xxhash64("doc_id", "text").alias("key"), "text")
    facts = shingle_join.map_batches(texts, shingle_join._facts(known, 5), shingle_join.FACTS)
    pairs = shingle_join.materialise(shingle_join.fingerprint_pairs(facts), "pairs")
    assert all(u < v for u, v in pairs.collect())
    links = shingle_join._near(pairs, texts, shingle_join.materialise(facts, "facts"), 5)
    group = dict(zip(names, want, strict=True))
    assert all(group[u] == group[v] for u, v in links.collect())
    linked = {r.node for r in components.components(links).collect()}
    near = {n for n, w in zip(names, want, strict=True) if want.count(w) > 1}
    assert len(near & linked) >= 0.8 * len(near)


def test_trie_connects_all_fingerprints_within_its_bits(spark, monkeypatch):
    """Also those that share no band, and sets that share a fingerprint."""
    monkeypatch.setattr(shingle_join, "BANDS", 1)
    rnd = random.Random(11)
    prints = []
    for _ in range(60):
        prints.append(rnd.getrandbits(64))
        for _ in range(rnd.randrange(5)):
            prints.append(prints[-1] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    rows = [(i, shingle_join.as_signed(p)) for i, p in enumerate(prints)]
    pairs = shingle_join.fingerprint_pairs(spark.createDataFrame(rows, "doc bigint, fingerprint bigint")).collect()
    assert all(r.u < r.v and (prints[r.u] ^ prints[r.v]).bit_count() <= shingle_join.MOST_BITS for r in pairs)
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for r in pairs:
        root[find(r.v)] = find(r.u)
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            assert (a ^ b).bit_count() > shingle_join.TRIE_BITS or find(i) == find(j)


def test_pipeline_walks_the_trie(spark, monkeypatch):
    walked, walk = [], simhash_trie.near_links
    monkeypatch.setattr(simhash_trie, "near_links", lambda prints, *rest: walked.append(prints.count()) or walk(prints, *rest))
    data = near_copies(7)
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, table(spark, data), "").select("doc_id").collect()}
    assert kept == set(brute([t for _, t in data]))
    assert walked and walked[0] > 50


def test_keep_one_of_edge_rows(spark):
    docs = table(spark)
    kept = shingle_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute([t for _, t in rows()])))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 5 in ids and 6 not in ids


def test_pipeline_keeps_no_near_copy(spark):
    """A fifth of the runs differ; 64 bits of runs of three words differ in more than three."""
    data = near_copies()
    docs = table(spark, data)
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").select("doc_id").collect()}
    assert kept == set(brute([t for _, t in data]))


def test_empty_table(spark):
    assert shingle_join.near_groups(table(spark, [])).count() == 0
    assert shingle_join.keep_one(table(spark, [])).count() == 0


def test_facts_do_not_stay_on_disk(spark):
    before = left(spark)
    kept = shingle_join.keep_one(table(spark))
    assert {name for name, _ in left(spark) - before} == {"links", "groups"}
    assert kept.count() == kept.count() > 0


def test_bucket_counts_bound_what_sets_share():
    rnd = random.Random(6)
    for _ in range(200):
        pool = np.array([rnd.getrandbits(63) for _ in range(rnd.choice([5, 300, 90_000]))], np.int64)
        a, b = (np.unique(rnd.choices(pool, k=len(pool))) for _ in range(2))
        found = [np.frombuffer(shingle_join.bucket_counts(s), np.uint8).astype(int) for s in (a, b)]
        bound = np.minimum(*found)
        assert (bound == shingle_join.FULL).any() or bound.sum() >= len(np.intersect1d(a, b))
        pairs = {"u": [1], "v": [2], "size_u": [len(a)], "size_v": [len(b)]}
        counts = {"of_u": [shingle_join.bucket_counts(a)], "of_v": [shingle_join.bucket_counts(b)]}
        stay = sum(x.num_rows for x in shingle_join._open(iter([pa.RecordBatch.from_pydict(pairs | counts)])))
        assert stay or 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b))


def test_tokens_meet_across_batches():
    rnd = random.Random(8)
    for _ in range(60):
        rows = sorted((rnd.randrange(6), rnd.randrange(5), 7, 0) for _ in range(rnd.randint(0, 40)))
        cuts = sorted(rnd.randint(0, len(rows)) for _ in range(4))
        batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = ["token", "doc", "size", "pos"]
        given = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in b], k) for i, k in enumerate(kinds)], names) for b in batches]
        got = [tuple(r.values()) for b in shingle_join._meet(iter(given)) for r in b.to_pylist()]
        distinct = sorted(set(rows))
        assert got == [r for r in distinct if sum(r[0] == o[0] for o in distinct) > 1]
