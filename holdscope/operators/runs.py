"""Stored cluster runs: resolving, replacing, listing and joining them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.operators.browse import equals
from holdscope.operators.skew import attach, ranked
from holdscope.session import cut_lineage
from holdscope.sources.tables import as_json


def run_id(*parts: Column) -> Column:
    """Stable id of a run from its natural key; an unset part keeps its place."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def list_runs(
    runs: DataFrame, algorithm: str | None = None, report_date: Any = None, limit: int = 20
) -> DataFrame:
    """Newest report date first, then newest run."""
    return (
        runs.filter(equals(algorithm=algorithm, report_date=report_date))
        .orderBy(F.col("report_date").desc(), F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
    )


def find_run(
    runs: DataFrame,
    report_date: Any,
    algorithm: str,
    k: int | None = None,
    product_type_filter: str | None = None,
) -> DataFrame:
    """The most recent run of a natural key; k and the filter are optional."""
    hits = runs.filter((F.col("report_date") == report_date) & (F.col("algorithm") == algorithm))
    if k is not None:
        hits = hits.filter(F.col("k") == k)
    if product_type_filter is not None:
        hits = hits.filter(F.col("product_type_filter") == product_type_filter)
    return hits.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)


def run_members(run: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    """Members of the given runs with product columns; a missing product leaves them empty."""
    ids = run.select(F.col("id").alias("cluster_run_id"))
    columns = ["institution_code", "product_code", "product_name", "product_type"]
    rows = members.join(ids, "cluster_run_id", "left_semi")
    named = attach(rows, products.select("product_id", *columns), ["product_id"])
    return named.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def run_clusters(run: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of the given runs with the run's own columns."""
    about = run.select(
        F.col("id").alias("cluster_run_id"), "report_date", "algorithm", "k", "silhouette", "inertia", "n_products"
    )
    own = [c for c in clusters.columns if c not in ("report_date", "algorithm", "k")]
    return clusters.select(*own).join(about, "cluster_run_id")


def member_list(members: DataFrame, cluster_id: Any, sort: str = "distance", limit: int = 200) -> DataFrame:
    """Members of one cluster by distance (unset last), institution or code."""
    orders = {
        "distance": [F.col("distance_to_center").asc_nulls_last(), F.col("product_id").asc()],
        "institution": [F.col("institution_code"), F.col("product_code"), F.col("product_id")],
        "code": [F.col("product_code"), F.col("product_id")],
    }
    if sort not in orders:
        raise ValueError(f"unknown member order: {sort}")
    return members.filter(F.col("cluster_id") == cluster_id).orderBy(*orders[sort]).limit(limit)


def memberships(members: DataFrame, runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every cluster each product was placed in, with run columns and cluster size."""
    about = runs.select(
        F.col("id").alias("cluster_run_id"), "report_date", "algorithm", "k", "product_type_filter", "created_at"
    )
    sizes = clusters.select("cluster_run_id", "cluster_id", F.col("size").alias("cluster_size"), "top_industries")
    placed = attach(
        members.select("cluster_run_id", "cluster_id", "product_id", "distance_to_center"),
        sizes,
        ["cluster_run_id", "cluster_id"],
        "inner",
    )
    return attach(placed, about, ["cluster_run_id"], "inner")


def run_totals(runs: DataFrame) -> DataFrame:
    """Runs, algorithms, dates and the newest run id."""
    newest = F.struct("report_date", "created_at", "id")
    return runs.agg(
        F.count(F.lit(1)).alias("run_total"),
        F.countDistinct("algorithm").alias("algo_total"),
        F.countDistinct("report_date").alias("date_total"),
        F.max(newest).getField("id").alias("latest_run"),
    )


def compare_runs(runs: DataFrame, bar_width: int = 40) -> DataFrame:
    """Runs with a known silhouette, a bar length against the best one, and the overall peaks."""
    known = runs.filter(F.col("silhouette").isNotNull())
    best = runs.agg(F.max("silhouette")).scalar()
    largest = runs.agg(F.max("n_products")).scalar()
    share = F.try_divide(F.col("silhouette"), best) * F.lit(bar_width)
    # Whole part toward zero, at least one.
    whole = F.when(share >= 0, F.floor(share)).otherwise(F.ceil(share))
    return known.select(
        "id",
        "algorithm",
        "k",
        "silhouette",
        F.greatest(F.lit(1), F.coalesce(whole, F.lit(1))).cast("int").alias("bar"),
        best.alias("max_silhouette"),
        largest.alias("max_products"),
    )


def runs_by_algorithm(runs: DataFrame) -> DataFrame:
    """Number of runs per algorithm."""
    return runs.groupBy("algorithm").agg(F.count(F.lit(1)).alias("runs"))


def superseded(
    runs: DataFrame,
    report_date: Any,
    algorithm: str,
    k: int,
    product_type_filter: str | None,
    mode: str = "full",
) -> DataFrame:
    """Ids of earlier runs that a new run of this key replaces.

    Runs other runs name as their baseline stay. An incremental run replaces only incremental
    ones.
    """
    prior = runs.filter(
        (F.col("report_date") == report_date)
        & (F.col("algorithm") == algorithm)
        & (F.col("k") == k)
        & F.col("product_type_filter").eqNullSafe(F.lit(product_type_filter))
    )
    if mode == "incremental":
        prior = prior.filter(F.col("mode") == "incremental")
    named = runs.filter(F.col("baseline_run_id").isNotNull()).select(F.col("baseline_run_id").alias("id"))
    return prior.select("id").join(named, "id", "left_anti")


def without_runs(table: DataFrame, gone: DataFrame, key: str = "cluster_run_id") -> DataFrame:
    """A run-keyed table after the given runs were removed."""
    return table.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def latest_baseline(
    baselines: DataFrame, algorithm: str, product_type_filter: str | None, feature_type: str
) -> DataFrame:
    """The newest baseline of a key; an unset filter matches only an unset filter."""
    return (
        baselines.filter(
            (F.col("algorithm") == algorithm)
            & (F.col("feature_type") == feature_type)
            & F.col("product_type_filter").eqNullSafe(F.lit(product_type_filter))
        )
        .orderBy(F.col("created_at").desc(), F.col("cluster_run_id").desc())
        .limit(1)
    )


def list_baselines(
    baselines: DataFrame, report_date: Any = None, algorithm: str | None = None, feature_type: str | None = None
) -> DataFrame:
    """Baselines that pass the given filters, newest first."""
    return baselines.filter(
        equals(report_date=report_date, algorithm=algorithm, feature_type=feature_type)
    ).orderBy(F.col("created_at").desc(), F.col("cluster_run_id").desc())


def run_payload(runs: DataFrame, clusters: DataFrame, members: DataFrame, per_row: int = 1000) -> DataFrame:
    """Each cluster of each run as JSON objects with all of its members, nearest first.

    A cluster of many members is several numbered ``part`` rows of at most ``per_row`` of them, so that nothing is cut and no
    list is unbounded; ``size`` tells how many members there are. A cluster without members is one part. Unset distances
    come last. A run without clusters is one row with an unset cluster.
    """
    keys = ["cluster_run_id", "cluster_id"]
    rows = members.select(*keys, "product_id", "distance_to_center")
    placed = ranked(cut_lineage(rows), keys, "distance_to_center", ["product_id"], out="_rank", descending=False)
    part = F.expr(f"cast((_rank - 1) div {per_row} as int)").alias("part")
    lists = placed.groupBy(*keys, part).agg(
        F.sort_array(F.collect_list(F.struct("_rank", "product_id", F.round("distance_to_center", 6).alias("distance")))).alias("_near")
    )
    listed = F.transform("_near", lambda x: F.struct(x["product_id"].alias("product_id"), F.format_string("%.6f", x["distance"]).alias("distance")))
    none = F.array().cast("array<struct<product_id:bigint,distance:string>>")
    shown = clusters.join(lists, keys, "left").select(
        "cluster_run_id", "cluster_id", "size", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce(listed, none).alias("members")
    )
    about = runs.select(F.col("id").alias("cluster_run_id"), "report_date", "algorithm", "k", "n_products")
    return as_json(about.join(shown, "cluster_run_id", "left"))
