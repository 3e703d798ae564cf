"""The manifest against a plain recursive tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import edges
import pytest
from pyspark.sql import functions as F

from holdscope.llm import merkle_manifest, queries
from holdscope.llm.merkle_manifest import VersionedTree, fold


def H(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(fields) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def brute_force(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    groups = {}
    key = lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))
    for r in sorted(rows, key=key):
        groups.setdefault(r[1], []).append(r)
    trees = {g: levels([leaf(r) for r in rs]) for g, rs in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for n, (g, rs) in enumerate(groups.items()):
        for i, r in enumerate(rs):
            steps = path(trees[g], i) + path(top, n)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for before, after in steps:
                node = H(before + node + after)
            proof = H("".join(b + a for b, a in steps))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def run(docs, height=merkle_manifest.HEIGHT):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle_manifest.manifest(docs, tampered, F.translate("text", "\n", ""), height=height)
    proof = F.sha2(F.array_join("path", ""), 256)
    rows = found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified").collect()
    return [tuple(r) for r in rows]


def by_place(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[4]))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_many_blocks_and_groups(spark, height):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "a", "a", None, "é", "zz", f"s{i}"]), None, i, f"t\n{i}") for i in range(130)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string").repartition(5)
    assert by_place(run(docs, height)) == by_place(brute_force(rows))


def test_edge_rows(spark):
    data = edges.rows()
    docs = edges.table(spark, data).drop("lang")
    names = {"source": F.when(F.length("text") % 3 == 0, "web"), "lang": F.lit(None).cast("string"), "n_chars": F.length("text")}
    docs = docs.withColumns(names).withColumns({c: F.lit("clash") for c in ("g", "digest", "tie", "block", "path", "leaf", "root", "_at")})
    rows = [(i, "web" if t is not None and len(t) % 3 == 0 else None, None, None if t is None else len(t), t) for i, t in data]
    assert by_place(run(docs)) == by_place(brute_force(rows))
    assert run(docs.limit(0)) == []
    one = docs.filter("doc_id = 5")
    assert by_place(run(one)) == by_place(brute_force([r for r in rows if r[0] == 5]))


def test_a_version_shares_what_it_does_not_change():
    tree = VersionedTree([H(str(i)) for i in range(20)])
    before, root = list(tree.digests), tree.digests[tree.root]
    new = tree.version(7, H("x"))
    assert tree.digests[: len(before)] == before and tree.digests[tree.root] == root
    assert len(tree.digests) - len(before) == len(tree.levels)
    assert tree.digests[new] == VersionedTree([H("x" if i == 7 else str(i)) for i in range(20)]).digests[-1]
    assert fold(H("x"), tree.steps(7)) == tree.digests[new] and fold(H("7"), tree.steps(7)) == root
    shared = set(tree.children[new]) & set(tree.children[tree.root])
    assert len(shared) == len(tree.children[new]) - 1


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    got = [tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, sf).collect()]
    assert by_place(got) == by_place(brute_force([tuple(r) for r in docs]))
