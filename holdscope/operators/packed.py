"""Products as packed sparse vectors, and a few centres that every task can hold.

A product is one row with the numbers of its features and their weights. Centres are a dense matrix, features as
columns. Its size is checked: beyond the broadcast bound ``pack`` gives nothing, and callers take their shuffled way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.operators.skew import fits_broadcast
from holdscope.session import cut_lineage, ship_package

#: Bounds are widened by this share, so that rounding never decides.
SLACK = 1e-9


@dataclass
class Packed:
    """``rows`` is (product_id, at, w), one per product; ``names`` has the feature of each number."""

    rows: DataFrame
    names: list
    n: int

    @property
    def id_type(self) -> str:
        return self.rows.schema["product_id"].dataType.simpleString()


def pack(points: DataFrame, centres: int) -> Packed | None:
    """The products of ``points``, if so many dense centres may be broadcast."""
    names = points.select("feature").distinct()
    if not fits_broadcast(names.count(), 8 * centres):
        return None
    found = sorted(r["feature"] for r in names.collect())
    kind = points.schema["feature"].dataType.simpleString()
    numbers = points.sparkSession.createDataFrame(list(zip(found, range(len(found)))), f"feature {kind}, at INT")
    rows = (
        points.join(F.broadcast(numbers), "feature")
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("v"))
        .select("product_id", F.col("v.at").alias("at"), F.col("v.weight").alias("w"))
    )
    rows = cut_lineage(rows)
    return Packed(rows, found, rows.count())


class Sparse:
    """The vectors of a batch, end to end."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        lists = [batch.column(c) for c in ("at", "w")]
        lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in lists]
        self.at, self.w = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        self.sizes = np.diff(lists[0].offsets.to_numpy())
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.xx = np.add.reduceat(self.w * self.w, self.begin) if len(self.sizes) else np.zeros(0)

    def __len__(self) -> int:
        return len(self.sizes)

    def squares(self, centre: np.ndarray, norm: float, rows: np.ndarray | None = None) -> np.ndarray:
        """Squared distances to a centre, never below zero."""
        if rows is None:
            dots = np.add.reduceat(centre[self.at] * self.w, self.begin)
            return np.maximum(self.xx + norm - 2 * dots, 0)
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        cells = np.arange(int(sizes.sum())) + np.repeat(self.begin[rows] - ends + sizes, sizes)
        dots = np.add.reduceat(centre[self.at[cells]] * self.w[cells], ends - sizes)
        return np.maximum(self.xx[rows] + norm - 2 * dots, 0)

    def sums(self, labels: np.ndarray, k: int, features: int) -> np.ndarray:
        """Sum of the vectors of each label."""
        cells = np.repeat(labels, self.sizes) * features + self.at
        return np.bincount(cells, self.w, k * features).reshape(k, features)


@dataclass
class Centres:
    """Groups of centres side by side: group ``g`` has the rows ``edges[g]`` to ``edges[g + 1]``."""

    values: np.ndarray
    edges: list[int]

    def __post_init__(self) -> None:
        self.norms = (self.values**2).sum(axis=1)
        sizes = np.diff(self.edges)
        most = int(np.argmax(sizes))
        self.pivots = np.arange(self.edges[most], self.edges[most + 1])
        gap = self.norms[self.pivots][:, None] + self.norms[None, :] - 2 * self.values[self.pivots] @ self.values.T
        self.between = np.sqrt(np.maximum(gap, 0))

    def nearest(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, int]:
        """For each product and group the nearest centre and its squared distance, and how many were computed.

        The largest group is computed in full. By the triangle inequality a distance lies within those to its centres plus
        or minus the gaps between centres; of the other groups only centres that may be nearest are computed.
        """
        n, groups = len(x), len(self.edges) - 1
        labels, squares = np.zeros((n, groups), np.int64), np.zeros((n, groups))
        if not n:
            return labels, squares, 0
        known = np.stack([x.squares(self.values[p], self.norms[p]) for p in self.pivots], axis=1)
        away, computed = np.sqrt(known), known.size
        for g in range(groups):
            own = np.arange(self.edges[g], self.edges[g + 1])
            if own[0] == self.pivots[0]:
                d2 = known
            else:
                least, most = np.zeros((n, len(own))), np.full((n, len(own)), np.inf)
                for i in range(len(self.pivots)):
                    gap, far = self.between[i, own][None, :], away[:, i : i + 1]
                    np.maximum(least, np.abs(far - gap), out=least)
                    np.minimum(most, far + gap, out=most)
                limit = most.min(axis=1, keepdims=True)
                maybe = least <= limit + SLACK * (1 + limit)
                d2 = np.full((n, len(own)), np.inf)
                for i, c in enumerate(own):
                    rows = np.flatnonzero(maybe[:, i])
                    if len(rows):
                        d2[rows, i] = x.squares(self.values[c], self.norms[c], rows)
                computed += int(maybe.sum())
            labels[:, g] = d2.argmin(axis=1)
            squares[:, g] = d2[np.arange(n), labels[:, g]]
        return labels, squares, computed


def map_packed(rows: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship_package(rows.sparkSession)
    return rows.mapInArrow(step, schema)


def cells_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the cells that are not zero."""
    j, at = np.nonzero(sums)
    return j, at, sums[j, at]


def batch_of(names: list[str], columns: list, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
