"""k-means on a sparse feature table.

Points are long rows (product_id, feature, weight). Centroids are one row per feature with a
column per cluster (``c0 .. c{k-1}``), so assigning points is one join on the feature and one
map-side-combined aggregate per product: a feature meets its k centroid values in one row and
no point x cluster x feature rows exist. The centroid table is counted once and broadcast
while features x k stays small; then an iteration shuffles no points at all. A larger table is
joined by a shuffle on the feature. While the centres may also be collected, whole runs go through
``kmeans_many``, a job per iteration; the loop here serves larger tables by the same rules.

Points are hashed by product once and reused by every iteration. The centroid table is
checkpointed each iteration, which keeps the plan short and survives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.operators.skew import attach, beside, fits_broadcast
from holdscope.session import cut_lineage


@dataclass
class Clustering:
    """Labels (product_id, cluster_id, d2), wide centroids and the run's numbers."""

    labels: DataFrame
    centroids: DataFrame
    k: int
    inertia: float
    n_iter: int
    silhouette: float | None = None


def _names(k: int) -> list[str]:
    return [f"c{j}" for j in range(k)]


def long_centroids(wide: DataFrame, k: int) -> DataFrame:
    """(cluster_id, feature, value) rows of a wide centroid table."""
    cells = F.array(*[F.col(c) for c in _names(k)])
    return wide.select("feature", F.posexplode(cells).alias("cluster_id", "value"))


def wide_centroids(long: DataFrame, k: int) -> DataFrame:
    """One row per feature and a column per cluster; absent cells are zero."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("cluster_id") == j, F.col("value"))), F.lit(0.0)).alias(c)
        for j, c in enumerate(_names(k))
    ]
    return long.groupBy("feature").agg(*columns)


def label_means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean vector of each label in long form; cells no member holds are absent."""
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    sums = (
        points.join(beside(labels.select("product_id", "cluster_id"), 32), "product_id")
        .groupBy("cluster_id", "feature")
        .agg(F.sum("weight").alias("s"))
    )
    return sums.join(sizes, "cluster_id").select("cluster_id", "feature", (F.col("s") / F.col("n")).alias("value"))


def prepare(points: DataFrame) -> DataFrame:
    """Points laid out by product for repeated passes; the caller unpersists."""
    return points.select("product_id", "feature", "weight").repartition("product_id").persist()


# The inner loop builds its expressions as SQL text: a text costs one call into the JVM where a
# tree of Column objects costs one per node, and a loop pays that every iteration.
def _squares(k: int) -> list[Column]:
    return [F.expr(f"coalesce(sum({c} * {c}), 0D) AS {c}") for c in _names(k)]


def measured(wide: DataFrame, k: int) -> tuple[list[float], bool]:
    """Squared length of each centroid, and whether the table may be broadcast."""
    row = list(wide.agg(*_squares(k), F.count(F.lit(1)).alias("n")).first())
    return row[:-1], fits_broadcast(row[-1], 8 * (k + 8))


def squared_norms(wide: DataFrame, k: int) -> list[float]:
    """Squared length of each centroid: k numbers."""
    return measured(wide, k)[0]


def distances(points: DataFrame, wide: DataFrame, norms: list[float], small: bool = False) -> DataFrame:
    """Squared distance of each product to each centroid (columns ``d0 ..``), never below zero.

    ``small`` says the centroid table was measured and may be broadcast.
    """
    k = len(norms)
    if small:
        met = points.join(F.broadcast(wide), "feature", "left")
    else:
        # A feature held by very many products is split by the join.
        met = attach(points, wide, ["feature"])
    dots = [F.expr(f"sum(weight * coalesce({c}, 0D)) AS _dot{j}") for j, c in enumerate(_names(k))]
    sums = met.groupBy("product_id").agg(F.expr("sum(weight * weight) AS _xx"), *dots)
    return sums.selectExpr(
        "product_id", *[f"greatest(_xx + {norms[j]!r}D - 2D * _dot{j}, 0D) AS d{j}" for j in range(k)]
    )


def _nearest(k: int) -> tuple[str, str]:
    """Smallest distance and its cluster as SQL; the lowest cluster id wins a tie."""
    low = f"least({', '.join(f'd{j}' for j in range(k))})" if k > 1 else "d0"
    picks = " ".join(f"WHEN d{j} = {low} THEN {j}" for j in range(k - 1))
    return low, f"CASE {picks} ELSE {k - 1} END" if picks else "0"


def assign(points: DataFrame, wide: DataFrame, norms: list[float], small: bool = False) -> DataFrame:
    """Nearest centroid of each product: (product_id, cluster_id, d2)."""
    low, pick = _nearest(len(norms))
    return distances(points, wide, norms, small).selectExpr(
        "product_id", f"CAST({pick} AS INT) AS cluster_id", f"{low} AS d2"
    )


def _uniform(seed: int, turn: int) -> Column:
    """A repeatable number in (0, 1] per product, independent of partitioning: 52 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:{turn}:"), F.col("product_id").cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (bits + 1).cast("double") / float(1 << 52)


def draw_first(products: DataFrame, seed: int):
    """The product with the smallest draw."""
    return products.agg(F.min_by("product_id", F.struct(_uniform(seed, 0), "product_id"))).first()[0]


def draw_next(distances_: DataFrame, seed: int, turn: int):
    """A product drawn with weight ``d2``: the smallest ``-ln(u) / d2``; the smallest ``u`` when all are zero."""
    u = _uniform(seed, turn)
    key = F.when(F.col("d2") > 0, -F.log(u) / F.col("d2"))
    row = distances_.agg(
        F.min_by("product_id", F.struct(key.isNull(), key, F.col("product_id"))).alias("far"),
        F.min_by("product_id", F.struct(u, F.col("product_id"))).alias("any"),
        F.max("d2").alias("top"),
    ).first()
    return row["far"] if row["top"] > 0 else row["any"]


def _as_centroids(points: DataFrame, picks: list) -> DataFrame:
    """Wide centroids that copy the vectors of the picked products."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("product_id") == p, F.col("weight"))), F.lit(0.0)).alias(f"c{j}")
        for j, p in enumerate(picks)
    ]
    return points.filter(F.col("product_id").isin(*picks)).groupBy("feature").agg(*columns)


def draw_some(products: DataFrame, k: int, seed: int) -> list:
    """The k products with the smallest draws."""
    drawn = products.select("product_id").orderBy(_uniform(seed, 0), "product_id").limit(k)
    return [r["product_id"] for r in drawn.collect()]


def seed_random(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k distinct products drawn by hash as starting centroids."""
    return _as_centroids(points, draw_some(points.select("product_id").distinct(), k, seed))


def seed_plus_plus(points: DataFrame, k: int, seed: int) -> DataFrame:
    """k-means++ start: each next centre is drawn with weight d² to the nearest one so far.

    One aggregate per centre.
    """
    picks = [draw_first(points, seed)]
    while len(picks) < k:
        wide = _as_centroids(points, picks)
        low, _ = _nearest(len(picks))
        wide = cut_lineage(wide)
        d = distances(points, wide, *measured(wide, len(picks))).selectExpr("product_id", f"{low} AS d2")
        picks.append(draw_next(d, seed, len(picks)))
    return _as_centroids(points, picks)


def update(
    points: DataFrame, labels: DataFrame, old: DataFrame, sizes: list[int], farthest, small: bool = False
) -> DataFrame:
    """New centroids (``c``) next to the old ones (``o``) for every feature of the points.

    A cluster without members takes the vector of ``farthest`` if given, else keeps its old
    centre.
    """
    columns, keep = [], []
    for j, n in enumerate(sizes):
        keep.append(farthest is None and n == 0)
        if n:
            columns.append(F.expr(f"sum(CASE WHEN cluster_id = {j} THEN weight END) / {float(n)!r}D AS n{j}"))
        elif farthest is not None:
            columns.append(F.sum(F.when(F.col("product_id") == farthest, F.col("weight"))).alias(f"n{j}"))
        else:
            columns.append(F.expr(f"CAST(NULL AS DOUBLE) AS n{j}"))
    new = points.join(labels.select("product_id", "cluster_id"), "product_id").groupBy("feature").agg(*columns)
    return new.join(F.broadcast(old) if small else old, "feature", "left").selectExpr(
        "feature",
        *[f"coalesce({'c' if keep[j] else 'n'}{j}, 0D) AS c{j}" for j in range(len(sizes))],
        *[f"coalesce(c{j}, 0D) AS o{j}" for j in range(len(sizes))],
    )


def lloyd(
    points: DataFrame,
    start: DataFrame,
    k: int,
    max_iter: int = 100,
    tol: float = 1e-4,
    keep_empty: bool = False,
) -> Clustering:
    """Assign and update until the centroids move less than ``tol``.

    ``points`` should come from ``prepare``. Labels and inertia belong to the last assignment,
    one update behind the returned centroids.
    """
    centroids = cut_lineage(start.select("feature", *_names(k)))
    # The feature count does not change, so one measurement holds for all iterations.
    norms, small = measured(centroids, k)
    n_iter = 0
    while True:
        n_iter += 1
        labels = assign(points, centroids, norms, small).persist()
        stats = labels.agg(
            F.expr("sum(d2) AS inertia"),
            F.expr("min_by(product_id, struct(-d2, product_id)) AS far"),
            *[F.expr(f"count_if(cluster_id = {j}) AS n{j}") for j in range(k)],
        ).first()
        sizes = [stats[f"n{j}"] for j in range(k)]
        moved = cut_lineage(update(points, labels, centroids, sizes, None if keep_empty else stats["far"], small))
        shift2 = " + ".join(f"(c{j} - o{j}) * (c{j} - o{j})" for j in range(k))
        row = moved.agg(F.expr(f"coalesce(sqrt(sum({shift2})), 0D) AS shift"), *_squares(k)).first()
        last = row["shift"] < tol or n_iter >= max_iter
        if last:
            # The labels of the result no longer depend on the points' cached layout.
            kept = cut_lineage(labels)
            labels.unpersist()
            return Clustering(kept, moved.select("feature", *_names(k)), k, float(stats["inertia"]), n_iter)
        labels.unpersist()
        centroids, norms = moved.select("feature", *_names(k)), list(row)[1:]


def check_start(n: int, k: int, init: str = "k-means++") -> None:
    if init not in ("k-means++", "random"):
        raise ValueError(f"unknown init: {init}")
    if not 0 < k <= n:
        raise ValueError(f"invalid k={k} for {n} products")


def kmeans(
    points: DataFrame,
    k: int,
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-4,
    init: str = "k-means++",
) -> Clustering:
    """Full k-means; an emptied cluster restarts at the point farthest from all centres."""
    from holdscope.operators import kmeans_many, packed  # they build on this module

    rows = packed.pack(points, k) if k > 0 else None
    if rows is not None:
        check_start(rows.n, k, init)
        draw = {"k-means++": kmeans_many.plus_plus, "random": kmeans_many.drawn_at_random}[init]
        return kmeans_many.lloyd_many(rows, {k: draw(rows, k, seed)}, max_iter, tol)[k]
    laid = prepare(points)
    try:
        return kmeans_of(laid, laid.select("product_id").distinct().count(), k, seed, max_iter, tol, init)
    finally:
        laid.unpersist()


def kmeans_of(
    laid: DataFrame,
    n: int,
    k: int,
    seed: int = 42,
    max_iter: int = 100,
    tol: float = 1e-4,
    init: str = "k-means++",
) -> Clustering:
    """Full k-means of ``n`` products that ``prepare`` laid out."""
    check_start(n, k, init)
    seeds = {"k-means++": seed_plus_plus, "random": seed_random}
    return lloyd(laid, seeds[init](laid, k, seed), k, max_iter, tol)


def kmeans_from(
    points: DataFrame, centroids: DataFrame, k: int, max_iter: int = 100, tol: float = 1e-4
) -> Clustering:
    """k-means from given wide centroids (warm start); an emptied cluster keeps its centre."""
    from holdscope.operators import kmeans_many, packed  # they build on this module

    rows = packed.pack(points, k) if k > 0 and fits_broadcast(centroids.count(), 8 * (k + 8)) else None
    if rows is not None:
        check_start(rows.n, k)
        start, outside = kmeans_many.given(rows, centroids, k)
        return kmeans_many.lloyd_many(rows, {k: start}, max_iter, tol, keep_empty=True, outside=outside)[k]
    check_start(points.select("product_id").distinct().count(), k)
    laid = prepare(points)
    try:
        return lloyd(laid, centroids, k, max_iter, tol, keep_empty=True)
    finally:
        laid.unpersist()


def member_distances(points: DataFrame, labels: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """Distance of each product to the centroid of its own cluster.

    A cell meets the k values of its feature, but only that of its own cluster is multiplied and goes on to the product.
    """
    norms, small = measured(centroids, k)
    owner = beside(labels.select("product_id", "cluster_id").distinct(), 32)
    placed = points.select("product_id", "feature", "weight").join(owner, "product_id")
    met = placed.join(F.broadcast(centroids), "feature", "left") if small else attach(placed, centroids, ["feature"])
    of = lambda values: F.element_at(F.array(*values), F.col("cluster_id") + 1)
    dot = F.sum(F.col("weight") * F.coalesce(of([F.col(c) for c in _names(k)]), F.lit(0.0)))
    sums = met.groupBy("product_id", "cluster_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("xx"), dot.alias("dot"))
    square = F.greatest(F.col("xx") + of([F.lit(n) for n in norms]) - 2 * F.col("dot"), F.lit(0.0))
    return sums.select("product_id", "cluster_id", F.sqrt(square).alias("distance_to_center"))
