"""Hard negatives against all products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdscope.llm import hard_negatives
from holdscope.llm.hard_negatives import Block, mine, summaries

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, block string, turn string, x string"


def brute_force(rows, every, positives=5, negatives=10):
    clean = {}
    for i, v, label in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2], str(r[1]))):
        if all(c is not None and math.isfinite(c) for c in v):
            clean.setdefault(i, (label, [math.floor(256 * float(np.float32(c))) for c in v]))
    sizes = [len(v) for _, v in clean.values()]
    common = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    clean = {i: x for i, x in clean.items() if len(x[1]) == common}
    out = set()
    for a, (label, v) in clean.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, same) for i, (same, w) in clean.items() if i != a]
        near = [(s, i) for s, i, other in sorted(scores) if other == label][:positives]
        for p, positive in near:
            fit = [(s, i) for s, i, other in sorted(scores) if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(a, positive, n, i, -p, -s) for n, (s, i) in enumerate(fit[:negatives], 1)}
    return out


def run(spark, rows, every, **how):
    data = [(*r, *["clash"] * 5) for r in rows]
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    found = mine(table, F.col("id") % every == 0, F.col("label"), **how).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def vectors(n, dim, seed, labels=3, of=None):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    draw = lambda c: [0.6 * m + rnd.gauss(0, 0.7) for m in centres[c]]
    return [(i, (of or draw)(i % labels), rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("dim", "block_rows"), [(64, 1000), (64, 40), (7, 60), (1, 50)])
def test_all_products(spark, dim, block_rows):
    rows = vectors(240, dim, dim)
    assert run(spark, rows, 10, block_rows=block_rows) == brute_force(rows, 10)


def test_copies_and_ties(spark):
    rows = vectors(60, 8, 3) + [(100 + i, [1.0, 0.5] * 4, i % 2) for i in range(120)]
    assert run(spark, rows, 10, block_rows=50) == brute_force(rows, 10)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(50, 4, 8)
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [nan, 0.0, 0.0, 0.0], 1), (230, [1.0, 2.0, 3.0, -inf], 0)]
    rows += [(240, [0.5] * 4, None), (None, [0.5] * 4, 1), (250, [0.0] * 4, 1), (260, [1.0, 1.0], 1), (270, [], 2)]
    rows += [rows[10], rows[10], (20, [0.1] * 4, 0), (280, [3e7, -2e7, 1e7, 5e6], 1), (290, [3e7, -2e7, 1e7, 4e6], 0)]
    assert run(spark, rows, 10) == brute_force(rows, 10)
    assert run(spark, [], 10) == set()
    assert run(spark, rows[:1], 10) == set()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(400, 64)).cumsum(axis=1) * 20)
    levels = [summaries(x, s) for s in hard_negatives.SEGMENTS]
    block = Block(np.arange(400), np.zeros(400, int), x, levels)
    exact, widths = x @ x[0], []
    for level in range(len(levels)):
        least, most = block.bounds(level, np.arange(400), [(m[0], d[0]) for m, d in levels])
        assert (least <= exact).all() and (exact <= most).all()
        widths.append((most - least).mean())
    assert widths[1] < widths[0] / 2
