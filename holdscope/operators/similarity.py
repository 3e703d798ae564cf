"""How alike two products are: overlap, cosine and Jaccard over sparse features."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators.skew import TASK_ROWS, attach, beside, fits_broadcast, ranked, width_of
from holdscope.session import cut_lineage, discard, materialise, materialised

#: Rows of a feature and cluster, with those that share its bucket, that are ranked in one task; more are cut into ranges.
HOT_ROWS = TASK_ROWS
#: Buckets in which features of a cluster are counted.
BUCKETS = 1 << 16

# Score of a pair from its matched-feature sums and the two products' own sums.
METRICS = {
    "overlap": lambda: F.coalesce("shared_min", F.lit(0.0)),
    "cosine": lambda: F.coalesce(
        F.try_divide(F.col("shared_dot"), F.col("norm") * F.col("target_norm")), F.lit(0.0)
    ),
    "jaccard": lambda: F.coalesce(
        F.try_divide(
            F.coalesce("shared_n", F.lit(0)),
            F.col("nonzero") + F.col("target_nonzero") - F.coalesce("shared_n", F.lit(0)),
        ),
        F.lit(0.0),
    ),
}
# Overlap and Jaccard read the portfolio weights, cosine the unit vectors.
METRIC_COLUMN = {"overlap": "raw_weight", "jaccard": "raw_weight", "cosine": "weight"}


def neighbors(
    cells: DataFrame, target: Any, metric: str = "overlap", top_n: int | None = 10, value: str | None = None
) -> DataFrame:
    """The products most similar to ``target``; zero scores count, ties go to the lowest id.

    ``value`` chooses raw or normalised weights; by default each metric has its own. A target
    without features is refused.

    Only the target's own features are joined (one row per feature), so the work is linear in
    the feature table. Sums per candidate combine on the map side.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    rows = cells.select("product_id", "feature", F.col(value or METRIC_COLUMN[metric]).alias("w"))
    mine = rows.filter(F.col("product_id") == target).select("feature", F.col("w").alias("t"))
    own = mine.agg(
        F.coalesce(F.sqrt(F.sum(F.col("t") * F.col("t"))), F.lit(0.0)).alias("target_norm"),
        F.count_if(F.col("t") != 0).alias("target_nonzero"),
    )
    others = rows.filter(F.col("product_id") != target)
    # The target's features are counted; beyond a broadcast, popular features are split by the join.
    n = mine.count()
    if not n:
        raise ValueError(f"no such product: {target}")
    if fits_broadcast(n, 64):
        met = others.join(F.broadcast(mine), "feature", "left")
    else:
        met = attach(others, mine, ["feature"])
    w, t = F.col("w"), F.col("t")
    both = (w != 0) & (t != 0)
    sums = (
        met.groupBy("product_id")
        .agg(
            F.sqrt(F.sum(w * w)).alias("norm"),
            F.count_if(w != 0).alias("nonzero"),
            # A feature absent on one side has weight zero there.
            F.sum(F.least(w, F.coalesce(t, F.lit(0.0)))).alias("shared_min"),
            F.sum(w * t).alias("shared_dot"),
            F.count_if(both).alias("shared_n"),
        )
        .withColumn("target_norm", own.select("target_norm").scalar())
        .withColumn("target_nonzero", own.select("target_nonzero").scalar())
    )
    scored = sums.select("product_id", F.lit(metric).alias("metric"), METRICS[metric]().alias("score"))
    if top_n is None:
        return scored
    return scored.orderBy(F.col("score").desc(), F.col("product_id").asc()).limit(top_n)


def mean_pairwise_overlaps(cells: DataFrame, labels: DataFrame, values: dict[str, str]) -> DataFrame:
    """Mean overlap over all product pairs of each cluster, without forming a pair, for several weights at once.

    ``values`` maps a weight column to the name of its mean. For one feature, the sum of ``min`` over all pairs is each
    weight times the number of products ranked above it. Features are dealt to tasks once for all weights; one held by very
    many products is ranked in value ranges, not in one task. Weights are not negative, so absent cells add nothing.
    """
    owner = beside(labels.select("product_id", "cluster_id"), 32)
    placed = cells.join(owner, "product_id").select("cluster_id", "feature", *values)
    # Cells that are in files already are read as they are; others are written, since they are counted and then dealt.
    own_files = not materialised(cells)
    rows = materialise(placed, "placed") if own_files else placed
    bucket = F.pmod(F.xxhash64("cluster_id", "feature"), F.lit(BUCKETS)).alias("bucket")
    counted = cut_lineage(rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")))
    hot = counted.filter(F.col("n") > HOT_ROWS).select("bucket")
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))]
    width = width_of(rows.sparkSession, counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if hot.isEmpty():
        totals = _ranked_whole(rows, list(values), width)
    else:
        marked = rows.withColumn("bucket", bucket)
        totals = _ranked_whole(marked.join(F.broadcast(hot), "bucket", "left_anti"), list(values), width)
        totals = totals.unionByName(_ranked_in_ranges(marked.join(F.broadcast(hot), "bucket", "left_semi"), list(values)))
    # A row per cluster; written, so that the shuffles of the rows leave the disk.
    totals = materialise(totals.groupBy("cluster_id").agg(*sums), "totals")
    if own_files:
        discard(rows)
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    pairs = F.greatest(n * (n - 1) / 2, F.lit(1.0))
    means = [F.when(n < 2, 0.0).otherwise(F.coalesce(f"s{i}", F.lit(0.0)) / pairs).alias(out) for i, out in enumerate(values.values())]
    return sizes.join(totals, "cluster_id", "left").select("cluster_id", *means)


def _ranked_whole(rows: DataFrame, values: list[str], width: int) -> DataFrame:
    """(cluster_id, s0 ..): sums of ``min`` over all pairs; the rows of a feature and cluster are sorted in one task.

    Every weight is sorted in the same tasks. Among equal weights any order gives the same sum.
    """
    ranked_rows = rows.repartition(width, "cluster_id", "feature")
    for i, c in enumerate(values):
        order = Window.partitionBy("cluster_id", "feature").orderBy(F.when(F.col(c) > 0, F.col(c)).desc_nulls_last())
        ranked_rows = ranked_rows.withColumn(f"_above{i}", F.row_number().over(order) - 1)
    sums = [F.sum(F.when(F.col(c) > 0, F.col(c) * F.col(f"_above{i}"))).alias(f"s{i}") for i, c in enumerate(values)]
    return ranked_rows.groupBy("cluster_id").agg(*sums)


def _ranked_in_ranges(rows: DataFrame, values: list[str]) -> DataFrame:
    """The same sums; equal weights are ranked as one row, and all are ranked in ranges of their order."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("w")) for i, c in enumerate(values)]))
    level = ["cluster_id", "feature", "kind", "w"]
    split = rows.select("cluster_id", "feature", each.alias("v")).filter("v.w > 0").select("cluster_id", "feature", "v.*")
    levels = cut_lineage(split.groupBy(*level).agg(F.count(F.lit(1)).alias("c")))
    pos = ranked(levels, ["cluster_id", "feature", "kind"], "w", ["w"], out="_upto", descending=True, weight=F.col("c"))
    c, above = F.col("c"), F.col("_upto") - F.col("c")
    pair_sum = F.col("w") * (c * above + c * (c - 1) / 2)
    sums = [F.sum(F.when(F.col("kind") == i, pair_sum)).alias(f"s{i}") for i in range(len(values))]
    return pos.groupBy("cluster_id").agg(*sums)


def mean_pairwise_overlap(
    cells: DataFrame, labels: DataFrame, value: str = "raw_weight", out: str = "avg_overlap"
) -> DataFrame:
    """Mean overlap over all product pairs of each cluster by one weight."""
    return mean_pairwise_overlaps(cells, labels, {value: out})
