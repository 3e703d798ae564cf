"""Silhouette and the choice of k."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators import silhouette as bounded
from holdscope.operators.clustering import Clustering, kmeans_of, prepare
from holdscope.operators.kmeans_many import kmeans_many
from holdscope.operators.packed import Sparse, pack
from holdscope.operators.skew import attach
from holdscope.session import cut_lineage, ship_package


def _all_pairs(points: DataFrame, labeled: DataFrame, names: list[list], sizes: dict, block_rows: int | None) -> DataFrame:
    """(product_id, run, other, total, members): sums of every product over every label, from all pairs of blocks."""
    numbers = cut_lineage(points.select("feature").distinct()).select("feature", F.monotonically_increasing_id().alias("at"))
    vectors = (
        attach(points, numbers, ["feature"])
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "weight"))).alias("v"))
        .select("product_id", F.col("v.at").alias("at"), F.col("v.weight").alias("w"))
    )
    packed = cut_lineage(labeled.join(vectors, "product_id"))
    n, cells = packed.agg(F.count(F.lit(1)), F.sum(F.size("at"))).first()
    rows = block_rows or bounded.rows_of(n, cells or 0, len(sizes))
    # A few blocks fill the cores; more keep a block within its bound.
    blocks = max(1, min(bounded.TURNS, n), -(-n // rows))
    block = F.pmod(F.xxhash64(F.col("product_id").cast("string")), F.lit(blocks)).cast("int")
    left = packed.withColumn("bi", block).withColumn("bj", F.explode(F.sequence(F.col("bi"), F.lit(blocks - 1))))
    right = packed.withColumn("bj", block).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("bj"))))
    edges = np.cumsum([0, *map(len, names)])
    shared = points.sparkSession.sparkContext.broadcast([np.array(x) for x in names])

    def own(table: pa.Table) -> np.ndarray:
        labels = np.array(table.column("labels").to_pylist(), np.int64)
        return np.stack([edges[r] + np.searchsorted(x, labels[:, r]) for r, x in enumerate(shared.value)], axis=1)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, y = Sparse(left), Sparse(right)
            (met_x, in_x), (met_y, in_y) = (bounded.members_of(own(t)) for t in (left, right))
            to_y, to_x = np.zeros((len(x), len(met_y))), np.zeros((len(y), len(met_x)))
            for a, b, d in bounded.strips(x, y):
                to_y[a:b] = d @ in_y
                to_x += d.T @ in_x[a:b]
            sides = [(left, met_y, to_y), (right, met_x, to_x)]
            for table, met, sums in sides[: 1 if key[0].as_py() == key[1].as_py() else 2]:
                who = np.repeat(np.arange(len(sums)), len(met))
                out.append(bounded.lists_of(table.column("product_id"), who, np.tile(met, len(sums)), sums.ravel(), len(sums)))
        none = bounded.lists_of(left.column("product_id").slice(0, 0), *[np.empty(0, np.int64)] * 3, 0)
        return pa.concat_tables(out) if out else none

    ship_package(packed.sparkSession)
    id_type = packed.schema["product_id"].dataType.simpleString()
    schema = f"product_id {id_type}, label array<int>, total array<double>"
    partial = left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj")).applyInArrow(meet, schema)
    return bounded.added_up(partial, names, sizes)


def label_sums(points: DataFrame, labelings: list[DataFrame], block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(product_id, run, other, total, members) of the clusters each product has to visit, and (product_id, labels).

    While centres of all clusters may be broadcast, products visit their own cluster and those that may be the nearest
    other one; beyond that, all pairs of blocks are computed.
    """
    labeled = None
    for i, one in enumerate(labelings):
        part = one.select("product_id", F.col("cluster_id").cast("long").alias(f"l{i}"))
        labeled = part if labeled is None else labeled.join(part, "product_id")
    labeled = labeled.join(points.select("product_id").distinct(), "product_id", "left_semi")
    labeled = cut_lineage(labeled.select("product_id", F.array(*[F.col(f"l{i}") for i in range(len(labelings))]).alias("labels")))
    sizes = labeled.select(F.posexplode("labels").alias("run", "own")).groupBy("run", "own").count()
    packed = pack(points, max(1, sizes.count()))
    counted = {(r["run"], r["own"]): r["count"] for r in sizes.collect()}
    names = [sorted(own for run, own in counted if run == i) for i in range(len(labelings))]
    if packed is None:
        return _all_pairs(points, labeled, names, counted, block_rows), labeled
    return bounded.mean_sums(packed, labeled, names, counted, block_rows), labeled


def silhouettes(points: DataFrame, labelings: list[DataFrame], block_rows: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette of several labelings in one pass: (run, silhouette).

    Each labeling is (product_id, cluster_id); ``run`` is its position in the list. A product visits the clusters that can
    decide its score, in blocks of bounded size, and returns one row per (product, label), never a pair. A product alone in
    its cluster has a = 0. The score is NULL with fewer than two labels or with as many labels as products.
    """
    per_label, labeled = label_sums(points, labelings, block_rows)
    n = labeled.count()
    own = labeled.select("product_id", F.posexplode("labels").alias("run", "own"))
    same = F.col("other") == F.col("own")
    scores = (
        per_label.join(own, ["product_id", "run"])
        .groupBy("product_id", "run")
        .agg(
            F.sum(F.when(same & (F.col("members") > 1), F.col("total") / (F.col("members") - 1))).alias("a"),
            F.min(F.when(~same, F.col("total") / F.col("members"))).alias("b"),
        )
        .withColumn("a", F.coalesce("a", F.lit(0.0)))
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    sizes = own.groupBy("run").agg(F.countDistinct("own").alias("labels"))
    valid = (F.col("labels") > 1) & (F.col("labels") < n)
    return (
        scores.groupBy("run")
        .agg(F.avg(score).alias("s"))
        .join(sizes, "run")
        .select("run", F.when(valid, F.col("s")).alias("silhouette"))
    )


def visited_share(points: DataFrame, labels: DataFrame) -> float:
    """Clusters that products visit, their own included, as a share of products times clusters."""
    visits, labeled = label_sums(points, [labels])
    return visits.count() / (labeled.count() * labels.select("cluster_id").distinct().count())


def silhouette(points: DataFrame, labels: DataFrame) -> float | None:
    """Mean silhouette of one labeling."""
    return silhouettes(points, [labels]).first()["silhouette"]


def search_k(
    points: DataFrame, ks: Iterable[int], seed: int = 42, max_iter: int = 100, tol: float = 1e-4
) -> tuple[DataFrame, dict[int, Clustering]]:
    """k-means for every k and one shared silhouette pass: (k, inertia, silhouette, n_iter).

    One loop carries the centres of all k; where these may not be broadcast together, each k runs on its own. An undefined
    silhouette counts as -1.
    """
    ks = list(ks)
    packed = pack(points, sum(ks))
    if packed is not None:
        runs = kmeans_many(packed, ks, seed, max_iter, tol)
    else:
        laid = prepare(points)
        try:
            n = laid.select("product_id").distinct().count()
            runs = {k: kmeans_of(laid, n, k, seed, max_iter, tol) for k in ks}
        finally:
            laid.unpersist()
    scores = {
        r["run"]: r["silhouette"] for r in silhouettes(points, [c.labels for c in runs.values()]).collect()
    }
    rows = []
    for i, (k, c) in enumerate(runs.items()):
        c.silhouette = scores[i]
        rows.append((k, c.inertia, -1.0 if scores[i] is None else scores[i], c.n_iter))
    table = points.sparkSession.createDataFrame(rows, "k INT, inertia DOUBLE, silhouette DOUBLE, n_iter INT")
    return table, runs


def _min_max(value: str) -> Column:
    """Scaled to 0..1 over the table; 0.5 when all values are equal."""
    w = Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(low == high, 0.5).otherwise((F.col(value) - low) / (high - low))


def composite_scores(table: DataFrame, elbow_weight: float = 0.3, elbow_sign: int = 1) -> DataFrame:
    """Silhouette plus weighted curvature of the log inertia, per k (one row per tried k).

    The curvature is left slope minus right slope and zero at both ends. That is most negative
    at a knee, so the default penalises it; ``elbow_sign=-1`` rewards the knee instead.
    """
    order = Window.orderBy("k")
    log = F.log(F.greatest(F.col("inertia"), F.lit(1e-12)))
    left, right = log - F.lag(log).over(order), F.lead(log).over(order) - log
    curved = table.withColumn("curvature", F.coalesce((left - right) * elbow_sign, F.lit(0.0)))
    return curved.withColumn("silhouette_norm", _min_max("silhouette")).withColumn(
        "curvature_norm", _min_max("curvature")
    ).withColumn("composite", F.col("silhouette_norm") + elbow_weight * F.col("curvature_norm"))


def best_by_silhouette(table: DataFrame) -> int:
    """k with the highest silhouette; the smallest k wins a tie."""
    return table.orderBy(F.col("silhouette").desc(), "k").first()["k"]


def select_k(
    points: DataFrame,
    k_min: int = 3,
    k_max: int = 12,
    elbow_weight: float = 0.3,
    elbow_sign: int = 1,
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-4,
) -> tuple[int, Clustering, DataFrame, str]:
    """Best k, its clustering, the search table and the name of the rule used."""
    table, runs = search_k(points, range(k_min, k_max + 1), seed, max_iter, tol)
    if len(runs) < 2:
        best = best_by_silhouette(table)
        return best, runs[best], table, "silhouette_only"
    scored = composite_scores(table, elbow_weight, elbow_sign)
    best = scored.orderBy(F.col("composite").desc(), "k").first()["k"]
    return best, runs[best], table, "silhouette_elbow_composite"
