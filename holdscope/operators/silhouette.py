"""Exact silhouettes that visit only the clusters that matter.

The mean distance of a product to a cluster is at least its distance to the centre and, by Jensen's inequality, at most
the root of that distance squared plus the cluster's variance. A product visits its own cluster and those whose interval
may hold the least mean. Members are laid out by the clusters of the finest labeling; a task gets a block of members and
products that visit them, both bounded by their cells. A task computes distances in strips, from the cells that two
vectors share or, where most cells are filled, by dense products; it returns one row per product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.operators.packed import SLACK, Centres, Packed, Sparse, cells_of, map_packed
from holdscope.operators.skew import fits_broadcast
from holdscope.session import cut_lineage, ship_package

#: Cells of a block of members, and of the products that visit it at a time; turns of a small table.
BLOCK_CELLS, TURNS = 3 << 20, 8
#: Distances at a time, and bytes of the sums of a block.
STRIP, SUM_BYTES = 4 << 20, 256 << 20
#: Vectors that fill so much of their features are multiplied as dense ones.
DENSE = 0.1
SQUARES = -2


class Shape:
    """Labels of all runs as numbers, and what is known of their clusters."""

    def __init__(self, names: list[list], centres: Centres, variance: np.ndarray, sizes: np.ndarray, together: np.ndarray):
        self.names, self.centres, self.variance, self.sizes = names, centres, variance, sizes
        #: Whether a cluster (row) shares members with a cluster of the finest run (column).
        self.together = together

    def numbers(self, labels: pa.Array) -> np.ndarray:
        """(product, run): the number of each label among all centres."""
        flat = np.array(labels.to_pylist(), np.int64).reshape(len(labels), len(self.names))
        return np.stack([self.centres.edges[r] + np.searchsorted(n, flat[:, r]) for r, n in enumerate(self.names)], axis=1)

    def visited(self, x: Sparse, own: np.ndarray) -> np.ndarray:
        """(product, cluster): whether its mean distance may be the least of another cluster, or the cluster is its own."""
        c = self.centres
        d2 = np.stack([x.squares(v, n) for v, n in zip(c.values, c.norms, strict=True)], axis=1)
        least, most = np.sqrt(d2), np.sqrt(d2 + self.variance[None, :])
        rows = np.arange(len(x))
        out = np.zeros(d2.shape, bool)
        for r in range(len(self.names)):
            a, b = c.edges[r], c.edges[r + 1]
            limit = most[:, a:b].copy()
            limit[rows, own[:, r] - a] = np.inf
            limit = limit.min(axis=1, keepdims=True)
            out[:, a:b] = least[:, a:b] <= limit + SLACK * (1 + limit)
            out[rows, own[:, r]] = True
        return out


def shape_of(rows: DataFrame, names: list[list], sizes: dict, features: int) -> Shape:
    """Centres and variances of all clusters, from one pass over the products."""
    edges = np.cumsum([0, *map(len, names)]).tolist()
    blank = Shape(names, Centres(np.zeros((edges[-1], features)), edges), np.zeros(edges[-1]), np.zeros(edges[-1]), None)
    finest = int(np.argmax([len(n) for n in names]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros((edges[-1], features)), np.zeros(edges[-1])
        met = np.zeros((edges[-1], len(names[finest])), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = Sparse(batch), blank.numbers(batch.column("labels"))
            for r in range(len(names)):
                a, b = edges[r], edges[r + 1]
                sums[a:b] += x.sums(own[:, r] - a, b - a, features)
                squares[a:b] += np.bincount(own[:, r] - a, x.xx, b - a)
                met[own[:, r], own[:, finest] - edges[finest]] = True
        j, at, value = cells_of(sums)
        m, g = np.nonzero(met)
        parts = [(j, at, value), (np.arange(edges[-1]), np.full(edges[-1], SQUARES), squares), (m, SQUARES - 1 - g, np.ones(len(m)))]
        j, at, value = (np.concatenate(p) for p in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(value, pa.float64())], ["j", "at", "value"]
        )

    found = map_packed(rows, step, "j int, at int, value double").groupBy("j", "at").agg(F.sum("value").alias("value")).toPandas()
    j, at, value = (found[c].to_numpy() for c in ("j", "at", "value"))
    count = np.array([sizes[r, name] for r, n in enumerate(names) for name in n], np.float64)
    sums, squares, together = np.zeros((edges[-1], features)), np.zeros(edges[-1]), np.zeros((edges[-1], len(names[finest])), bool)
    cell, square, met = at >= 0, at == SQUARES, at < SQUARES
    sums[j[cell], at[cell]] = value[cell]
    squares[j[square]] = value[square]
    together[j[met], SQUARES - 1 - at[met]] = True
    centres = Centres(sums / count[:, None], edges)
    return Shape(names, centres, np.maximum(squares / count - centres.norms, 0), count, together)


def rows_of(n: int, cells: int, clusters: int) -> int:
    """Products of a block, by its cells and the sums that it may return."""
    return max(1, min(BLOCK_CELLS * n // max(cells, 1), max(512, SUM_BYTES // (8 * clusters))))


class Columns:
    """The vectors of a block by feature: members and weights of ``names[i]`` are ``begin[i]`` to ``begin[i + 1]``."""

    def __init__(self, y: Sparse):
        order = np.argsort(y.at, kind="stable")
        self.names, first = np.unique(y.at[order], return_index=True)
        self.begin = np.append(first, len(order))
        self.members = np.repeat(np.arange(len(y)), y.sizes)[order]
        self.w = y.w[order]
        self.xx = y.xx
        self.dense = None
        if len(order) >= DENSE * len(y) * len(self.names):
            self.dense = np.zeros((len(self.names), len(y)))
            self.dense[np.repeat(np.arange(len(first)), np.diff(self.begin)), self.members] = self.w

    def __len__(self) -> int:
        return len(self.xx)

    def distances(self, x: Sparse, a: int, b: int) -> np.ndarray:
        """Euclidean distances of the vectors ``a`` to ``b`` of ``x`` to all members."""
        cells = slice(x.begin[a], x.begin[b - 1] + x.sizes[b - 1])
        at, w, row = x.at[cells], x.w[cells], np.repeat(np.arange(b - a), x.sizes[a:b])
        found = np.minimum(np.searchsorted(self.names, at), len(self.names) - 1)
        here = self.names[found] == at
        found, w, row = found[here], w[here], row[here]
        if self.dense is not None:
            wide = np.zeros((b - a, len(self.names)))
            wide[row, found] = w
            cross = wide @ self.dense
        else:
            size = self.begin[found + 1] - self.begin[found]
            ends = np.cumsum(size)
            entries = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[found] - ends + size, size)
            places = np.repeat(row * len(self), size) + self.members[entries]
            cross = np.bincount(places, np.repeat(w, size) * self.w[entries], (b - a) * len(self))
            cross = cross.astype(np.float64, copy=False).reshape(b - a, len(self))  # without a cell they are integers
        cross *= -2
        cross += x.xx[a:b, None]
        cross += self.xx[None, :]
        return np.sqrt(np.maximum(cross, 0, out=cross), out=cross)


def strips(x: Sparse, y: Sparse) -> Iterator[tuple[int, int, np.ndarray]]:
    """Distances of all vectors of two blocks, some of ``x`` at a time."""
    columns = Columns(y)
    step = max(1, STRIP // len(y))
    for a in range(0, len(x), step):
        b = min(a + step, len(x))
        yield a, b, columns.distances(x, a, b)


def distances(a: Sparse, b: Sparse) -> np.ndarray:
    """Euclidean distances of all vectors of two blocks."""
    return np.concatenate([d for _, _, d in strips(a, b)])


def members_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the labels met in (product, run), and for each product and label whether it has it."""
    met = np.unique(own)
    out = np.zeros((len(own), len(met)))
    out[np.arange(len(own))[:, None], np.searchsorted(met, own)] = 1.0
    return met, out


def lists_of(ids: pa.ChunkedArray, who: np.ndarray, label: np.ndarray, total: np.ndarray, n: int) -> pa.Table:
    """(product_id, label, total): a row per product with what it has to add to labels; ``who`` ascends."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in ((label, pa.int32()), (total, pa.float64()))]
    return pa.table([ids, *lists], names=["product_id", "label", "total"])


def added_up(partial: DataFrame, names: list[list], sizes: dict) -> DataFrame:
    """(product_id, run, other, total, members) from rows of lists; a total has all members of its label."""
    spark = partial.sparkSession
    of = [(i, r, int(name), int(sizes[r, name])) for i, (r, name) in enumerate((r, x) for r, n in enumerate(names) for x in n)]
    told = spark.createDataFrame(of, "label INT, run INT, other LONG, members LONG")
    # Lists are small to shuffle; what they hold then is where it is added up.
    each = partial.repartition("product_id").select("product_id", F.explode(F.arrays_zip("label", "total")).alias("c"))
    sums = each.groupBy("product_id", F.col("c.label").alias("label")).agg(F.sum("c.total").alias("total"))
    return sums.join(F.broadcast(told), "label").select("product_id", "run", "other", "total", "members")


def mean_sums(packed: Packed, labeled: DataFrame, names: list[list], sizes: dict, block_rows: int | None = None) -> DataFrame:
    """(product_id, run, other, total, members): distance sums of products to the clusters they visit, in blocks.

    ``labeled`` has product_id and ``labels``, one per run; ``names`` the sorted labels of each run, ``sizes`` the number of
    products by (run, label). Sums of visited clusters are complete when they are added up.
    """
    spark = labeled.sparkSession
    rows = cut_lineage(packed.rows.join(labeled, "product_id"))
    shape = shape_of(rows, names, sizes, len(packed.names))
    finest = int(np.argmax([len(n) for n in names]))
    first, edges = shape.centres.edges[finest], shape.centres.edges
    per_block = block_rows or rows_of(packed.n, rows.agg(F.sum(F.size("at"))).first()[0] or 0, edges[-1])
    slices = np.maximum(1, -(-shape.sizes[first : edges[finest + 1]].astype(int) // per_block))
    turns = max(1, min(TURNS, packed.n), -(-packed.n // per_block))
    shared = spark.sparkContext.broadcast(shape)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Shape = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = Sparse(batch), s.numbers(batch.column("labels"))
            seen = s.visited(x, own)
            groups = (seen.astype(np.float32) @ s.together.astype(np.float32)) > 0
            columns = [batch.column(c) for c in ("product_id", "at", "w")]
            columns.append(pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary()))
            columns.append(pa.array([np.flatnonzero(g).astype(np.int32) for g in groups], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["product_id", "at", "w", "seen", "groups"])

    hashed = F.xxhash64(F.col("product_id").cast("string"))
    per_group = F.array(*[F.lit(int(n)) for n in slices])
    asks = map_packed(rows, visits, f"product_id {packed.id_type}, at array<int>, w array<double>, seen binary, groups array<int>")
    asks = cut_lineage(asks)
    asks = asks.withColumn("turn", F.pmod(hashed, F.lit(turns)).cast("int")).withColumn("grp", F.explode("groups")).drop("groups")
    asks = asks.withColumn("slice", F.explode(F.sequence(F.lit(0), per_group[F.col("grp")] - 1)))
    # The finest run's label of a member as its number in that run.
    own = F.array_position(F.array(*[F.lit(n) for n in names[finest]]), F.col("labels")[finest]) - 1
    members = rows.withColumn("grp", own.cast("int")).withColumn("slice", F.pmod(hashed, per_group[F.col("grp")]).cast("int"))
    # A block goes to the turns that ask for it.
    asked = asks.select(*[F.col(c).alias(c) for c in ("grp", "slice", "turn")]).distinct()
    members = members.join(asked, ["grp", "slice"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        s: Shape = shared.value
        n, width = left.num_rows, len(s.sizes)
        if not n or not right.num_rows:
            return lists_of(left.column("product_id").slice(0, 0), *[np.empty(0, np.int64)] * 3, 0)
        x, y = Sparse(left), Sparse(right)
        met, inside = members_of(s.numbers(right.column("labels").combine_chunks()))
        seen = np.frombuffer(b"".join(left.column("seen").to_pylist()), np.uint8).reshape(n, -1)
        seen = np.unpackbits(seen, axis=1, count=width).astype(bool)[:, met]
        sums = np.concatenate([d @ inside for _, _, d in strips(x, y)])
        who, at = np.nonzero(seen)
        return lists_of(left.column("product_id"), who, met[at], sums[who, at], n)

    ship_package(spark)
    schema = f"product_id {packed.id_type}, label array<int>, total array<double>"
    partial = asks.groupBy("grp", "slice", "turn").cogroup(members.groupBy("grp", "slice", "turn")).applyInArrow(meet, schema)
    return added_up(partial, names, sizes)


def fits(labels: int, features: int) -> bool:
    return fits_broadcast(features, 8 * labels)
