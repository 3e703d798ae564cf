from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdscope.llm import queries, rp_forest

SCHEMA = "vec_id bigint, embedding array<double>, id string, v string, query_id string"


def asks():
    return F.col("id") % 20 == 0


def frame(spark, data):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in data], SCHEMA).repartition(3)


def exact(data, k=20):
    data = {i: np.array(v) for i, v in data}
    out = []
    for q in sorted(i for i in data if i % 20 == 0):
        ranked = sorted((-float((data[i] * data[q]).sum()), i) for i in data if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return out


def test_recall_on_the_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES["op10_nearest_neighbours"](spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    hits = []
    for q, group in found.groupby("query_id"):
        own = x @ x[ids == q][0]
        own[ids == q] = -np.inf
        best = np.lexsort((ids, -own))[:20]
        hits.append(len(set(ids[best]) & set(group.vec_id)) / 20)
        group = group.sort_values("rank")
        assert group["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own[np.searchsorted(ids, group.vec_id)], group.score, atol=1e-12)
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


def test_all_leaves_open_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (300, 6)), 1) * rng.choice([1, 10], (300, 1))
    data = [(int(i), row.tolist()) for i, row in enumerate(x) if row.any()]
    found = rp_forest.nearest(frame(spark, data), asks(), k=7, examined=1.0, block_rows=64).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found)
    assert got == [(q, r, i, round(s, 9)) for q, r, i, s in exact(data, 7)]


@pytest.mark.parametrize("depth", [0, 3, 10])
def test_any_depth_loses_no_leaf(spark, depth):
    x = np.random.default_rng(4).normal(0, 1, (900, 5))
    data = [(int(i), row.tolist()) for i, row in enumerate(x)]
    found = rp_forest.nearest(frame(spark, data), asks(), k=5, depth=depth, examined=1.0, block_rows=200, trees=3).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found)
    assert got == [(q, r, i, round(s, 9)) for q, r, i, s in exact(data, 5)]


def test_a_share_is_examined(spark):
    x = np.random.default_rng(6).normal(0, 1, (4000, 16))
    forest = rp_forest.grow(x, float(np.linalg.norm(x, axis=1).max()), 32, 7)
    cells = rp_forest.Cells(forest.leaves(x), 128)
    sizes = [len(cells.members(m)) for m in forest.opened(x[:40], 0.4)]
    assert 0.25 * 4000 < np.mean(sizes) <= 0.42 * 4000
    for row, leaves in zip(range(0, 4000, 500), forest.leaves(x)[::500], strict=True):
        own = np.zeros((32, 128), bool)
        own[np.arange(32), leaves] = True
        assert row in cells.members(own.ravel())


def test_a_third_of_equal_vectors(spark):
    rng = np.random.default_rng(5)
    data = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.normal(0, 1, 3).tolist()) for i in range(240)]
    found = rp_forest.nearest(frame(spark, data), asks(), examined=1.0).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found)
    assert got == [(q, r, i, round(s, 9)) for q, r, i, s in exact(data)]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    bad = [(40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 1.0]), (160, [])]
    found = rp_forest.nearest(frame(spark, good + bad), asks()).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.5), (20, 1, 3, 1.0), (20, 2, 0, 0.5)]


@pytest.mark.parametrize("data", [[], [(20, [1.0, 2.0])], [(20, None)]])
def test_few_or_no_rows(spark, data):
    assert rp_forest.nearest(frame(spark, data), asks()).count() == 0
