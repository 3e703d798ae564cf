"""k-means on packed products, for one start or for several k in one loop.

The centres of all k stand side by side. A round is one job: every task assigns its products for all k that still move,
with most distances ruled out by the triangle inequality, and returns sums per centre. Each k ends on its own, by the same
rules as ``clustering.lloyd``; the number of jobs grows with the longest run, not with the number of k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.operators.clustering import Clustering, draw_first, draw_next, draw_some
from holdscope.operators.packed import Centres, Packed, Sparse, cells_of, map_packed
from holdscope.session import cut_lineage

#: Numbers in place of a feature, for what a round tells besides sums.
SIZE, INERTIA, FAR = -1, -2, -3


def vector_of(packed: Packed, product) -> np.ndarray:
    row = packed.rows.filter(F.col("product_id") == F.lit(product)).first()
    out = np.zeros(len(packed.names))
    out[row["at"]] = row["w"]
    return out


def plus_plus(packed: Packed, k: int, seed: int) -> np.ndarray:
    """k-means++ centres. The first of them are those of any smaller k, since a draw depends on its turn alone."""
    picks = [vector_of(packed, draw_first(packed.rows, seed))]
    while len(picks) < k:
        shared = packed.rows.sparkSession.sparkContext.broadcast(Centres(np.stack(picks), [0, len(picks)]))

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, d2, _ = shared.value.nearest(Sparse(batch))
                yield pa.RecordBatch.from_arrays([batch.column("product_id"), pa.array(d2[:, 0])], ["product_id", "d2"])

        found = map_packed(packed.rows, step, f"product_id {packed.id_type}, d2 double")
        picks.append(vector_of(packed, draw_next(found, seed, len(picks))))
        shared.unpersist()
    return np.stack(picks)


def _round(packed: Packed, centres: Centres) -> pd.DataFrame:
    """Sums, sizes, inertia and the farthest product of every group: (j, at, value, id), collected within the bound."""
    features = len(packed.names)
    shared = packed.rows.sparkSession.sparkContext.broadcast(centres)
    id_type = packed.rows.schema["product_id"].dataType

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Centres = shared.value
        groups = len(c.edges) - 1
        sums, sizes = np.zeros_like(c.values), np.zeros(len(c.values))
        inertia, far, kind = np.zeros(groups), [(-1.0, None)] * groups, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Sparse(batch)
            labels, d2, _ = c.nearest(x)
            inertia += d2.sum(axis=0)
            ids = batch.column("product_id")
            kind = ids.type
            for g in range(groups):
                a, b = c.edges[g], c.edges[g + 1]
                sums[a:b] += x.sums(labels[:, g], b - a, features)
                sizes[a:b] += np.bincount(labels[:, g], minlength=b - a)
                top = d2[:, g].max()
                first = min(ids[i].as_py() for i in np.flatnonzero(d2[:, g] == top))
                if top > far[g][0] or (top == far[g][0] and first < far[g][1]):
                    far[g] = float(top), first
        if kind is None:
            return
        j, at, value = cells_of(sums)
        every = np.arange(len(sizes))
        parts = [(j, at, value), (every, np.full(len(sizes), SIZE), sizes)]
        parts += [(np.arange(groups), np.full(groups, INERTIA), inertia)]
        parts += [(np.arange(groups), np.full(groups, FAR), np.array([f[0] for f in far]))]
        columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
        ids = pa.concat_arrays([pa.nulls(len(columns[0]) - groups, kind), pa.array([f[1] for f in far], kind)])
        arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64()), ids]
        yield pa.RecordBatch.from_arrays(arrays, ["j", "at", "value", "id"])

    rows = map_packed(packed.rows, step, f"j int, at int, value double, id {id_type.simpleString()}")
    first = F.min(F.when(F.col("at") == FAR, F.struct((-F.col("value")).alias("v"), "id")))["id"]
    found = rows.groupBy("j", "at").agg(F.sum("value").alias("value"), first.alias("id")).toPandas()
    shared.unpersist()
    return found


def kmeans_many(packed: Packed, ks: Sequence[int], seed: int, max_iter: int, tol: float) -> dict[int, Clustering]:
    """Full k-means for every k; an emptied cluster restarts at the point farthest from all centres.

    ``ks`` are distinct numbers between one and the number of products. Labels and inertia belong to the last assignment,
    one update behind the returned centroids.
    """
    if not all(0 < k <= packed.n for k in ks):
        raise ValueError(f"invalid k among {list(ks)} for {packed.n} products")
    start = plus_plus(packed, max(ks), seed)
    return lloyd_many(packed, {k: start[:k] for k in ks}, max_iter, tol)


def drawn_at_random(packed: Packed, k: int, seed: int) -> np.ndarray:
    """The vectors of k distinct products drawn by hash."""
    return np.stack([vector_of(packed, p) for p in draw_some(packed.rows, k, seed)])


def given(packed: Packed, wide: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Wide centroids over the packed features, and the squared length of what each has in other features."""
    at = {name: i for i, name in enumerate(packed.names)}
    start, outside = np.zeros((k, len(at))), np.zeros(k)
    for row in wide.select("feature", *[f"c{j}" for j in range(k)]).collect():
        values = np.array([0.0 if v is None else v for v in row[1:]])
        if row[0] in at:
            start[:, at[row[0]]] = values
        else:
            outside += values * values
    return start, outside


def lloyd_many(
    packed: Packed,
    starts: dict[int, np.ndarray],
    max_iter: int,
    tol: float,
    keep_empty: bool = False,
    outside: np.ndarray | None = None,
) -> dict[int, Clustering]:
    """The loop from one start per k, by the rules of ``clustering.lloyd``.

    ``outside`` is what centres of a single start have besides the packed features; it ends with the first update.
    """
    ks, now = list(starts), dict(starts)
    done: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float, int]] = {}
    n_iter = 0
    while now:
        n_iter += 1
        active = list(now)
        edges = np.cumsum([0, *active]).tolist()
        centres = Centres(np.concatenate([now[k] for k in active]), edges)
        if outside is not None and n_iter == 1:
            centres.norms = centres.norms + outside
        found = _round(packed, centres)
        sums = np.zeros_like(centres.values)
        cells = found[found["at"] >= 0]
        sums[cells["j"], cells["at"]] = cells["value"]
        told = {kind: found[found["at"] == kind].set_index("j") for kind in (SIZE, INERTIA, FAR)}
        sizes = told[SIZE]["value"].reindex(range(len(sums))).to_numpy()
        for g, k in enumerate(active):
            a, b = edges[g], edges[g + 1]
            new = sums[a:b] / np.maximum(sizes[a:b], 1)[:, None]
            empty = sizes[a:b] == 0
            if empty.any():
                new[empty] = now[k][empty] if keep_empty else vector_of(packed, told[FAR].loc[g, "id"])
            if np.sqrt(((new - now[k]) ** 2).sum()) < tol or n_iter >= max_iter:
                done[k] = centres.values[a:b], centres.norms[a:b], new, float(told[INERTIA].loc[g, "value"]), n_iter
                del now[k]
            else:
                now[k] = new
    return _finished(packed, ks, done)


def _finished(packed: Packed, ks: list[int], done: dict) -> dict[int, Clustering]:
    """The labels of all k from one pass with their last centres but one."""
    spark = packed.rows.sparkSession
    last = Centres(np.concatenate([done[k][0] for k in ks]), np.cumsum([0, *ks]).tolist())
    last.norms = np.concatenate([done[k][1] for k in ks])
    shared = spark.sparkContext.broadcast(last)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, d2, _ = shared.value.nearest(Sparse(batch))
            arrays = [batch.column("product_id"), pa.array(list(labels.astype(np.int32)), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(d2), pa.list_(pa.float64()))], ["product_id", "labels", "d2"])

    schema = f"product_id {packed.id_type}, labels array<int>, d2 array<double>"
    labels = cut_lineage(map_packed(packed.rows, step, schema))
    shared.unpersist()
    out = {}
    for i, k in enumerate(ks):
        _, _, centres, inertia, n_iter = done[k]
        own = labels.select("product_id", F.col("labels")[i].alias("cluster_id"), F.col("d2")[i].alias("d2"))
        table = pd.DataFrame(centres.T, columns=[f"c{j}" for j in range(k)])
        table.insert(0, "feature", packed.names)
        out[k] = Clustering(own, spark.createDataFrame(table), k, inertia, n_iter)
    return out
