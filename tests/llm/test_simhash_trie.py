from __future__ import annotations

import numpy as np
import pytest
import xxhash
from edges import rows, table

from holdscope.llm import components, simhash_trie


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(simhash_trie.ascii_words.__globals__["ASCII_LOWER"]).split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], budget: int) -> dict[int, int]:
    """Smallest print that each print reaches, over all pairs."""
    near = {p: {q for q in prints if (p ^ q).bit_count() <= budget} for p in prints}
    root: dict[int, int] = {}
    for p in sorted(near):
        todo = [p]
        while todo:
            q = todo.pop()
            if q not in root:
                root[q] = p
                todo += near[q]
    return root


def test_groups_of_edge_rows(spark):
    found = simhash_trie.near_groups(table(spark)).collect()
    want = [(d, t, fingerprint(t)) for d, t in rows()]
    root = groups([p for _, _, p in want], 3)
    least: dict[int, int] = {}
    for d, _, p in want:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in found)
    assert got == sorted((d is None, d or 0, f"{p:016x}", least.get(root[p])) for d, _, p in want)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_links_against_all_pairs(spark, budget):
    """Random prints, dense clusters and chains, in many cells."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64) * np.uint64(2)
    prints = {int(x) for x in rng.integers(0, 2**63, 500, dtype=np.uint64)}
    for c in centres.tolist():
        for _ in range(40):
            flips = rng.integers(0, 64, rng.integers(0, 5))
            prints.add(c ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64))) if len(flips) else c)
    prints |= {0, 2**64 - 1}
    data = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    df = spark.createDataFrame(data, "fingerprint bigint")
    links = simhash_trie.near_links(df, budget, cell_rows=30).collect()
    for u, v in links:
        assert 0 < ((u ^ v) % 2**64).bit_count() <= budget
    want = groups(sorted(prints), budget)
    found = components.components(spark.createDataFrame(links, "u bigint, v bigint"))
    root = {r.node % 2**64: r.root % 2**64 for r in found.collect()}
    pairs = {(root.get(p, p), want[p]) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(want.values()))


def test_dense_group_gives_a_forest():
    """All of 4096 prints lie within 3 bits of others: links stay below one per print."""
    prints = np.arange(4096, dtype=np.uint64) << np.uint64(20)
    links = simhash_trie.trie_links(prints, (0, 4096), [], 3)
    assert len(links) == 4095


def test_keep_one_of_each_group(spark):
    docs = table(spark)
    kept = simhash_trie.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(d, t, fingerprint(t)) for d, t in rows()]
    root = groups([p for _, _, p in want], 3)
    assert kept.count() == len(set(root.values()))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 5 in ids and 6 not in ids


def test_empty_table(spark):
    assert simhash_trie.near_groups(table(spark, [])).count() == 0
    assert simhash_trie.keep_one(table(spark, [])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}}
