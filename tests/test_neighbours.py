"""Neighbours of every product against all pairs."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest

from holdscope.operators import holdings, neighbours

SCHEMA = "product_id LONG, feature STRING, raw_weight DOUBLE, weight DOUBLE"


def cells(seed, n, styles, spread):
    """Products of a few styles, each with its own features and some that all share."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        style = rnd.randrange(styles)
        own = rnd.sample(range(12), rnd.randint(2, 6))
        weights = {f"s{style}f{f}": round(rnd.random() + 0.5, 3) for f in own}
        weights |= {f"all{f}": round(rnd.random() * spread, 3) for f in rnd.sample(range(5), rnd.randint(0, 2))}
        norm = sum(w * w for w in weights.values()) ** 0.5
        out += [(i, f, w, w / norm) for f, w in weights.items()]
    return out


def brute_force(rows, metric, n):
    vectors = {}
    for i, f, raw, unit in rows:
        w = unit if metric == "cosine" else raw
        if w:
            vectors.setdefault(i, {})[f] = w
    out = set()
    for i, a in vectors.items():
        scores = []
        for j, b in vectors.items():
            shared = a.keys() & b.keys()
            if metric == "overlap":
                s = sum(min(a[f], b[f]) for f in shared)
            elif metric == "cosine":
                s = sum(a[f] * b[f] for f in shared)
            else:
                s = len(shared) / len(a.keys() | b.keys())
            if i != j:
                scores.append((-round(s, 9), j))
        out |= {(i, rank, j, round(-s, 6)) for rank, (s, j) in enumerate(sorted(scores)[:n], 1)}
    return out


@pytest.mark.parametrize("metric", ["overlap", "cosine", "jaccard"])
@pytest.mark.parametrize(("n", "block_rows", "top_n"), [(150, 16, 4), (150, 1000, 7), (12, 3, 20)])
def test_every_product_against_all_pairs(spark, metric, n, block_rows, top_n):
    rows = cells(n, n, 6, 0.3)
    table = spark.createDataFrame(rows, SCHEMA)
    found = neighbours.neighbors_of_all(table, metric, top_n, block_rows=block_rows).collect()
    got = {(r["product_id"], r["rank"], r["neighbor_id"], round(r["score"], 6)) for r in found}
    assert len(got) == len(found)
    assert got == brute_force(rows, metric, top_n)


def test_a_block_is_searched_without_a_step_per_pair(spark):
    """Products that all share a few features each: no list ends early, and all members of a block are met."""
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        w = {f"f{f}": rnd.random() + 0.01 for f in rnd.sample(range(1500), 60)}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(i, f, x, x / norm) for f, x in w.items()]
    table = spark.createDataFrame(rows, SCHEMA).cache()
    start = time.time()
    found = neighbours.neighbors_of_all(table, "cosine", 5).collect()
    assert time.time() - start < 60
    assert len(found) == 15000
    some = {0, 1500, 2999}
    own = {i: {f: unit for j, f, _, unit in rows if j == i} for i in some}
    scores = {i: {} for i in some}
    for j, f, _, unit in rows:
        for i in some:
            if i != j and f in own[i]:
                scores[i][j] = scores[i].get(j, 0.0) + own[i][f] * unit
    for i in some:
        want = sorted((-round(s, 9), j) for j, s in scores[i].items())[:5]
        got = [(r["neighbor_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["product_id"] == i]
        assert [j for j, _ in got] == [j for _, j in want]
        assert [s for _, s in got] == pytest.approx([-s for s, _ in want])


def test_copies_of_a_product_grow_with_blocks_of_bounded_cells(spark, monkeypatch):
    table = spark.createDataFrame(cells(4, 200, 6, 0.3), SCHEMA)
    assert neighbours.laid_out(table, "overlap", None, None).select("block").distinct().count() <= neighbours.BLOCKS
    monkeypatch.setattr(neighbours, "BLOCK_CELLS", 50)
    total = table.filter("raw_weight <> 0").count()
    assert neighbours.laid_out(table, "overlap", None, None).agg({"block": "max"}).first()[0] <= -(-total // 50)


def test_blocks_of_other_styles_are_not_visited(spark):
    table = spark.createDataFrame(cells(3, 300, 6, 0.05), SCHEMA)
    assert neighbours.visited_share(table, "overlap", 3, block_rows=20) < 0.5


def test_few_products(spark):
    one = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", 0.0, 0.0)], SCHEMA)
    assert neighbours.neighbors_of_all(one).collect() == []
    assert neighbours.neighbors_of_all(one.limit(0)).collect() == []
    with pytest.raises(ValueError):
        neighbours.neighbors_of_all(one, "euclid")


def test_rounds_meet_all_blocks_once_and_leave_the_disk(spark, monkeypatch):
    """However many blocks there are, a round copies each product twice at most, and no step stays on disk."""
    rows = cells(6, 150, 6, 0.3)
    table = spark.createDataFrame(rows, SCHEMA)
    neighbours.neighbors_of_all(table.limit(0))  # names the shared folder
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {x.name for x in folder.iterdir()}
    monkeypatch.setattr(neighbours, "ROUND_CELLS", 1)
    rounds, search = [], neighbours.searched_elsewhere

    def watched(products, pairs, *rest):
        rounds.append(pairs)
        return search(products, pairs, *rest)

    monkeypatch.setattr(neighbours, "searched_elsewhere", watched)
    found = neighbours.neighbors_of_all(table, "overlap", 4, block_rows=20)
    assert {(r["product_id"], r["rank"], r["neighbor_id"], round(r["score"], 6)) for r in found.collect()} == brute_force(rows, "overlap", 4)
    blocks = 1 + max(j for pairs in rounds for _, j in pairs)
    assert blocks > 5
    met = [p for pairs in rounds for p in pairs]
    assert sorted(met) == [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    for pairs in rounds:
        assert max(sum(b in p for p in pairs) for b in range(blocks)) <= 2
    left = [x for x in folder.iterdir() if x.name not in before and "-" in x.name and any(x.glob("*.parquet"))]
    assert [x.name.rsplit("-", 1)[0] for x in left] == ["best"]


def test_features_are_numbered_without_a_gap(spark):
    names = spark.range(1000).selectExpr("cast(id as string) AS feature").repartition(7)
    found = neighbours.numbered(neighbours.materialise(names, "names"))
    assert sorted(r["at"] for r in found.collect()) == list(range(1000))
    assert neighbours.numbered(neighbours.materialise(names.limit(0), "names")).count() == 0


def test_norms_do_not_derive_the_cells_twice(spark):
    table = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "product_id LONG, feature STRING, raw_weight DOUBLE")
    unit = holdings.l2_normalised(table)
    assert unit._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert {(r.product_id, r.feature, r.weight) for r in unit.collect()} == {(1, "a", 0.6), (1, "b", 0.8), (2, "a", 0.0)}
