"""Nearest neighbours by inner product through a forest of random-projection trees.

The trees are grown on a bounded sample; every vector is then routed to its leaf in each tree. A query keeps one priority
queue over the nodes of all trees, nearest side first, and opens leaves from it until some share of all vectors is
expected in them, a share that falls as the table grows. The distinct vectors of the open leaves are compared with the
query, each once, by their exact inner product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import map_batches, materialise, ragged_ranges
from holdscope.session import ship_package

TREES, LEAF_ROWS = 32, 32
#: A query examines ``EXAMINED * rows ** -0.2`` of all vectors, as if trees were independent; in fact somewhat less.
EXAMINED = 3.1
#: Bound of the sample that the trees are grown on, and its least rows per leaf.
SAMPLE_ROWS, LEAF_SAMPLE = 16_384, 8
#: Vectors of a block, and queries of a task.
BLOCK_ROWS, QUERY_ROWS = 16_384, 131_072
#: Rows that go down the trees at a time.
ROUTED_ROWS = 2048
SEED = 5


@dataclass
class Forest:
    """Planes of each tree, level by level. ``reach`` is the largest norm; vectors get one more component up to it."""

    reach: float
    depth: int
    normals: list[np.ndarray]
    offsets: list[np.ndarray]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """With the added component all vectors are equally long, so the largest product is the smallest angle."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x * (self.reach / norm), np.zeros_like(norm)])
        return np.hstack([x, np.sqrt(np.maximum(self.reach**2 - norm**2, 0))])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normals, offsets) in enumerate(zip(self.normals, self.offsets, strict=True)):
            node = out[:, t]
            for _ in range(self.depth):
                for at in range(0, len(x), ROUTED_ROWS):
                    some = slice(at, at + ROUTED_ROWS)
                    along = np.einsum("ij,ij->i", x[some], normals[node[some]])
                    node[some] = 2 * node[some] + 1 + (along >= offsets[node[some]])
            node -= (1 << self.depth) - 1
        return out

    def opened(self, x: np.ndarray, share: float) -> np.ndarray:
        """For each query a mask over the leaves of all trees, opened through the shared queue.

        Leaves are opened until a share of all vectors is expected in them: with a part c of the leaves of a tree open, it
        misses 1 - c of the vectors, and all trees together the product of these.
        """
        inner, trees = (1 << self.depth) - 1, len(self.normals)
        lifted = self.lifted(x, query=True)
        open_leaves = np.zeros((len(x), trees, inner + 1), bool)
        least = np.log(max(1 - share, 1e-12))
        for q in range(len(x)):
            margins = [(n @ lifted[q] - o).tolist() for n, o in zip(self.normals, self.offsets, strict=True)]
            queue = [(0.0, t, 0) for t in range(trees)]
            counts, missed = [0] * trees, 0.0
            while queue and missed > least:
                far, t, node = heapq.heappop(queue)
                margin = margins[t]
                while node < inner:
                    side = margin[node] >= 0
                    heapq.heappush(queue, (max(far, abs(margin[node])), t, 2 * node + 2 - side))
                    node = 2 * node + 1 + side
                open_leaves[q, t, node - inner] = True
                rest = inner + 1 - counts[t]
                counts[t] += 1
                missed += np.log((rest - 1) / rest) if rest > 1 else -np.inf
        return open_leaves.reshape(len(x), -1)


def grow(sample: np.ndarray, reach: float, trees: int, depth: int) -> Forest:
    """Planes between two random members of a node, through the median of its members."""
    rng = np.random.default_rng(SEED)
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) // LEAF_SAMPLE)))))
    forest = Forest(reach, depth, [], [])
    x = forest.lifted(sample)
    for _ in range(trees):
        normals, offsets = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
        groups = [np.arange(len(x))]
        for node in range((1 << depth) - 1):
            members = groups[node]
            a, b = rng.choice(members, 2, replace=False) if len(members) > 1 else (0, 0)
            normal = x[a] - x[b]
            normal = normal / (np.linalg.norm(normal) or 1.0)
            along = x[members] @ normal
            offsets[node] = np.median(along) if len(members) else 0.0
            normals[node] = normal
            groups += [members[along < offsets[node]], members[along >= offsets[node]]]
        forest.normals.append(normals)
        forest.offsets.append(offsets)
    return forest


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: one row per id, with vectors as arrays of doubles, without those that take no part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = rows.filter(f"id is not null and v is not null and {finite} and exists(v, x -> x <> 0)")
    one = Window.partitionBy("id").orderBy("v")
    return rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    depth: int | None = None,
    examined: float | None = None,
    sample_rows: int = SAMPLE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``asks`` holds of the id, its ``k`` nearest found.

    Nearness is the largest inner product in double precision, ties go to the smaller id; a query is never its own
    neighbour. ``asks`` is a condition on a column named ``id``. Every vector is indexed; the trees are grown on at most
    ``sample_rows`` of them, ``depth`` levels deep (by default so that a leaf has some 32 rows, as far as the sample
    allows). A query opens leaves until it is expected to examine the share ``examined`` of all vectors (by default one
    that falls with the number of rows), so neighbours may be missed. With few vectors there is one leaf, and with a
    share of 1 all are open: then the search is exact.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part; nor do vectors
    whose size is not the most common one (the smaller of equals). Of rows that share an id the smallest vector counts.
    Of equal vectors only the ``k + 1`` smallest ids can be among anyone's nearest, so only these are compared.
    An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    rows = rows.filter(F.size("v") == dim)
    copies = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n")
    index = materialise(index, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = index.agg(F.count("*").alias("n"), F.max(norm).alias("reach")).first()
    chosen = index.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    sample = np.array([r["v"] for r in chosen], np.float64).reshape(-1, dim)
    n = max(1, facts["n"])
    depth = max(0, int(np.log2(max(1, n // LEAF_ROWS)))) if depth is None else depth
    share = min(1.0, EXAMINED * n**-0.2) if examined is None else examined
    shared = spark.sparkContext.broadcast(grow(sample, facts["reach"] or 1.0, trees, depth))
    ship_package(spark)

    def packed(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
        x = batch.column("v").values.to_numpy(zero_copy_only=False).astype("<f8")
        x = x[batch.column("v").offsets[0].as_py() :][: batch.num_rows * dim].reshape(-1, dim)
        return x, pa.array([r.tobytes() for r in x], pa.binary())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, v = packed(batch)
                leaves = pa.array([r.tobytes() for r in shared.value.leaves(x).astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), v, leaves], ["id", "v", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, v = packed(batch)
                masks = pa.array([np.packbits(r).tobytes() for r in shared.value.opened(x, share)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), v, masks], ["id", "v", "opened"])

    n_leaves = 1 << shared.value.depth
    n_blocks = max(1, -(-facts["n"] // block_rows))
    n_asked = rows.filter(asks).count()
    n_turns = max(1, -(-n_asked // QUERY_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    placed = (
        map_batches(index, place, "id bigint, v binary, leaves binary")
        .withColumn("block", deal(n_blocks))
        .withColumn("turn", every(n_turns))
    )
    asked = (
        map_batches(rows.filter(asks), ask, "id bigint, v binary, opened binary")
        .withColumn("turn", deal(n_turns))
        .withColumn("block", every(n_blocks))
    )

    def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if members.num_rows and queries.num_rows:
            members = members.sort_by("id")
            x, q = _matrix(members.column("v"), dim), _matrix(queries.column("v"), dim)
            ids, asking = members.column("id").to_numpy(), queries.column("id").to_numpy()
            inside = Cells(np.frombuffer(b"".join(members.column("leaves").to_pylist()), "<u2").reshape(len(ids), -1), n_leaves)
            for i, mask in enumerate(queries.column("opened").to_pylist()):
                some = inside.members(np.unpackbits(np.frombuffer(mask, np.uint8), count=trees * n_leaves).astype(bool))
                _keep_best(x, ids, some, q[i], asking[i], k, found)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds, strict=True)]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    ship_package(spark)
    met = (
        placed.groupBy("block", "turn")
        .cogroup(asked.groupBy("block", "turn"))
        .applyInArrow(meet, "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Cells:
    """Rows of a block by tree and leaf."""

    def __init__(self, leaves: np.ndarray, n_leaves: int):
        self.rows, trees = len(leaves), leaves.shape[1]
        cell = leaves.astype(np.int64) + n_leaves * np.arange(trees)[None, :]
        order = np.argsort(cell.T, axis=None, kind="stable")
        self.order = order % self.rows
        self.counts = np.bincount(cell.ravel(), minlength=trees * n_leaves)
        self.begin = np.cumsum(self.counts) - self.counts

    def members(self, opened: np.ndarray) -> np.ndarray:
        """The distinct rows of the open leaves."""
        cells = np.flatnonzero(opened)
        seen = np.zeros(self.rows, bool)
        seen[self.order[ragged_ranges(self.begin[cells], self.counts[cells])]] = True
        return np.flatnonzero(seen)


def _keep_best(x, ids, some: np.ndarray, q: np.ndarray, asking: int, k: int, found: list[list]) -> None:
    """One product of the query with each of ``some`` rows; the best ``k`` go to ``found``."""
    some = some[ids[some] != asking]
    exact = (x[some] * q).sum(axis=1)
    if len(some) > k:
        best = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
        some, exact = some[best], exact[best]
    first = np.lexsort((ids[some], -exact))[:k]
    found[0].append(np.full(len(first), asking))
    found[1].append(ids[some[first]])
    found[2].append(exact[first])
