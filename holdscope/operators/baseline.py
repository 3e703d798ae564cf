"""Baselines of earlier runs: aligning their centroids and judging the drift since."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DriftLimits:
    """A check fails when its value passes the limit."""

    feature_jaccard_min: float = 0.80
    n_products_change_ratio: float = 0.20
    silhouette_min: float = 0.05
    silhouette_drop_ratio: float = 0.25
    inertia_change_ratio: float = 0.50


def align_centroids(centroids: DataFrame, features: DataFrame) -> DataFrame:
    """Wide centroids on a new feature list: new features are zero, vanished ones drop."""
    aligned = features.select("feature").distinct().join(centroids, "feature", "left")
    return aligned.na.fill(0.0)


def feature_jaccard(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shared over all distinct features of two sets; two empty sets are alike."""
    a = old.select("feature").distinct().withColumn("a", F.lit(1))
    b = new.select("feature").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "feature", "full")
    n = F.count(F.lit(1))
    return both.agg(
        F.when(n == 0, 1.0)
        .otherwise(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), n))
        .alias("feature_jaccard")
    )


def drift_checks(numbers: DataFrame, limits: DriftLimits = DriftLimits()) -> DataFrame:
    """The check table (check, value, threshold, violated) of one comparison row.

    ``numbers`` has one row with ``feature_jaccard``, ``n_products``, ``silhouette``,
    ``inertia`` and their ``base_`` counterparts. A missing current silhouette counts as -1; a
    zero or missing baseline silhouette switches the drop check off. A baseline without
    silhouette or inertia is incomplete, which alone forces a full run.
    """
    sil = F.coalesce("silhouette", F.lit(-1.0))
    base_sil, base_inertia = F.col("base_silhouette"), F.col("base_inertia")
    change = F.abs(F.col("n_products") - F.col("base_n_products")) / F.greatest("base_n_products", F.lit(1))
    drop = F.when(base_sil != 0, F.try_divide(base_sil - sil, F.abs(base_sil)))
    moved = F.when(base_inertia > 0, F.try_divide(F.abs(F.col("inertia") - base_inertia), base_inertia))
    complete = (base_sil.isNotNull() & base_inertia.isNotNull()).cast("double")

    def check(name: str, value: Column, limit: float, low: bool) -> Column:
        value = value.cast("double")
        bad = value < limit if low else value > limit
        return F.struct(
            F.lit(name).alias("check"),
            value.alias("value"),
            F.lit(limit).alias("threshold"),
            F.coalesce(bad, F.lit(False)).alias("violated"),
        )

    checks = F.array(
        check("feature_jaccard", F.col("feature_jaccard"), limits.feature_jaccard_min, True),
        check("n_products_change_ratio", change, limits.n_products_change_ratio, False),
        check("silhouette_min", sil, limits.silhouette_min, True),
        check("silhouette_drop_ratio", drop, limits.silhouette_drop_ratio, False),
        check("inertia_change_ratio", moved, limits.inertia_change_ratio, False),
        check("baseline_complete", complete, 1.0, True),
    )
    return numbers.select(F.inline(checks))


def needs_full_run(checks: DataFrame) -> bool:
    """True when any check is violated."""
    return bool(checks.agg(F.max("violated")).first()[0])
