"""The analysis run: features, clustering with warm start and fallback, profiles, attribution.

Control flow stays on the driver (which mode, whether to fall back); every data step is a
Spark job over the stored tables.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.operators import attribution, baseline, clustering, holdings, profiling, runs, selection, timeseries
from holdscope.operators.baseline import DriftLimits
from holdscope.operators.clustering import Clustering
from holdscope.session import cut_lineage
from holdscope.sources import store
from holdscope.sources.tables import read_table, write_table

log = logging.getLogger(__name__)


class DriftError(RuntimeError):
    """An incremental run was asked for but its result drifted too far from the baseline."""


@dataclass(frozen=True)
class Settings:
    """Parameters of a clustering run."""

    algorithm: str = "kmeans"
    k: int | str = "auto"
    k_min: int = 3
    k_max: int = 12
    random_seed: int = 42
    max_iter: int = 100
    tol: float = 1e-4
    min_holdings: int = 3
    product_types: tuple[str, ...] = ("equity", "mixed")
    asset_types: tuple[str, ...] = ("stock",)
    normalize: bool = True
    elbow_weight: float = 0.3
    limits: DriftLimits = field(default_factory=DriftLimits)


def build_features(
    spark: SparkSession, root: str, report_date: date, settings: Settings, feature_type: str = "asset"
) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """Feature cells, merge map, products and industries of a report date, from the stored tables."""
    products = read_table(spark, root, "product_info").withColumnRenamed("id", "product_id")
    held = read_table(spark, root, "product_holding")
    industries = holdings.security_industries(read_table(spark, root, "holding_security_info"))
    rows = holdings.cross_section(
        products, held, report_date, settings.product_types, settings.asset_types, settings.min_holdings
    )
    cells, merge_map = holdings.features(rows, feature_type, industries, normalize=settings.normalize)
    return cut_lineage(cells), merge_map, products, industries


def run_full(cells: DataFrame, settings: Settings) -> tuple[Clustering, DataFrame | None]:
    """k-means with a fixed k, or with k chosen by search; the search table if there was one."""
    s = settings
    if s.k == "auto":
        _, result, table, _ = selection.select_k(
            cells, s.k_min, s.k_max, s.elbow_weight, seed=s.random_seed, max_iter=s.max_iter, tol=s.tol
        )
        return result, table
    result = clustering.kmeans(cells, int(s.k), s.random_seed, s.max_iter, s.tol)
    result.silhouette = selection.silhouette(cells, result.labels)
    return result, None


def run_warm(
    cells: DataFrame, base: Any, base_centroids: DataFrame, settings: Settings
) -> tuple[Clustering, DataFrame]:
    """k-means from a baseline's centroids, and the drift checks against that baseline."""
    spark, k = cells.sparkSession, base["k"]
    wide = clustering.wide_centroids(base_centroids, k)
    start = baseline.align_centroids(wide, cells)
    result = clustering.kmeans_from(cells, start, k, settings.max_iter, settings.tol)
    result.silhouette = selection.silhouette(cells, result.labels)
    n = cells.select("product_id").distinct().count()
    numbers = spark.createDataFrame(
        [(n, result.silhouette, result.inertia, base["n_products"], base["silhouette"], base["inertia"])],
        "n_products BIGINT, silhouette DOUBLE, inertia DOUBLE, base_n_products BIGINT, "
        "base_silhouette DOUBLE, base_inertia DOUBLE",
    ).withColumn("feature_jaccard", baseline.feature_jaccard(wide, cells).scalar())
    return result, baseline.drift_checks(numbers, settings.limits)


def cluster(
    spark: SparkSession,
    root: str,
    report_date: date,
    settings: Settings = Settings(),
    feature_type: str = "asset",
    mode: str = "auto",
    now: datetime | None = None,
    features: tuple[DataFrame, DataFrame | None, DataFrame, DataFrame] | None = None,
    save: bool = True,
) -> dict[str, Any]:
    """Cluster the products of a report date and store run, clusters, members and baseline.

    ``auto`` warm-starts from the newest baseline if there is one and falls back to a full run
    when the drift checks fail; ``incremental`` raises instead; ``full`` always starts over. A
    full run becomes the new baseline.
    """
    if mode not in ("auto", "full", "incremental"):
        raise ValueError(f"invalid mode: {mode}")
    now = now or datetime.utcnow()
    cells, merge_map, products, industries = features or build_features(
        spark, root, report_date, settings, feature_type
    )
    types = ",".join(settings.product_types)
    algorithm = f"{settings.algorithm}-{feature_type}"

    base = None
    if mode != "full":
        stored = read_table(spark, root, "similarity_cluster_baseline")
        base = runs.latest_baseline(stored, algorithm, types, feature_type).first()
        if base is None and mode == "incremental":
            raise ValueError(f"no baseline for {algorithm}; run with mode 'full' or 'auto' first")

    checks = search = None
    run_mode = "full" if base is None else "incremental"
    if base is not None:
        centroids = read_table(spark, root, "similarity_baseline_centroids").filter(
            F.col("cluster_run_id") == base["cluster_run_id"]
        )
        result, checks = run_warm(cells, base, centroids, settings)
        checks = cut_lineage(checks)
        if baseline.needs_full_run(checks):
            if mode == "incremental":
                raise DriftError(f"incremental run drifted from its baseline: {checks.collect()}")
            log.warning("%s on %s drifted from its baseline; running in full", algorithm, report_date)
            run_mode = "full"
    if run_mode == "full":
        result, search = run_full(cells, settings)

    sizes = cells.agg(F.countDistinct("product_id"), F.countDistinct("feature")).first()
    params = {**asdict(settings), "feature_type": feature_type, "report_date": str(report_date), "mode": run_mode}
    if checks is not None:
        params["incremental_diagnostics"] = [r.asDict() for r in checks.collect()]
    searched = None if search is None else [r.asDict() for r in search.collect()]
    if searched:
        params["k_search_results"] = searched
    base_id = base["cluster_run_id"] if run_mode == "incremental" else None
    run = spark.createDataFrame(
        [
            (report_date, types, algorithm, result.k, json.dumps(params), result.silhouette, result.inertia,
             sizes[0], sizes[1], now, run_mode, base_id)
        ],
        "report_date DATE, product_type_filter STRING, algorithm STRING, k INT, params_json STRING, "
        "silhouette DOUBLE, inertia DOUBLE, n_products BIGINT, n_features BIGINT, created_at TIMESTAMP_NTZ, "
        "mode STRING, baseline_run_id STRING",
    )
    key = [F.col(c) for c in ("report_date", "algorithm", "k", "product_type_filter", "created_at")]
    run = run.withColumn("id", runs.run_id(*key))
    run_id = run.first()["id"]
    if save:
        save_run(root, run, result, cells, products, merge_map, industries, feature_type, run_mode, searched)
    return {
        "cluster_run_id": run_id,
        "report_date": report_date,
        "algorithm": algorithm,
        "k": result.k,
        "mode": run_mode,
        "baseline_run_id": base_id,
        "n_products": sizes[0],
        "n_features": sizes[1],
        "silhouette": result.silhouette,
        "inertia": result.inertia,
        "n_iter": result.n_iter,
        "k_search_results": searched,
        "drift_checks": checks,
    }


def save_run(
    root: str,
    run: DataFrame,
    result: Clustering,
    cells: DataFrame,
    products: DataFrame,
    merge_map: DataFrame | None,
    industries: DataFrame,
    feature_type: str,
    mode: str,
    searched: list | None,
) -> None:
    """Store a run in place of the runs it supersedes; a full run also becomes the baseline."""
    spark = run.sparkSession
    head = run.first()
    key = (head["report_date"], head["algorithm"], head["k"], head["product_type_filter"])
    gone = cut_lineage(runs.superseded(read_table(spark, root, "similarity_cluster_run"), *key, mode))
    stamp = {
        "cluster_run_id": F.lit(head["id"]),
        "report_date": F.lit(head["report_date"]),
        "product_type_filter": F.lit(head["product_type_filter"]),
        "algorithm": F.lit(head["algorithm"]),
        "k": F.lit(head["k"]),
        "created_at": F.lit(head["created_at"]).cast("timestamp_ntz"),
    }
    long = cut_lineage(clustering.long_centroids(result.centroids, result.k))
    placed = cut_lineage(clustering.member_distances(cells, result.labels, result.centroids, result.k))
    profiles = profiling.build_profiles(
        cells,
        result.labels,
        long,
        placed,
        products,
        merge_map,
        industries if feature_type == "asset" else None,
        feature_type,
    )
    store.replace_runs(root, "similarity_clusters", profiles.withColumns(stamp), gone, "cluster_run_id")
    store.replace_runs(root, "similarity_cluster_members", placed.withColumns(stamp), gone, "cluster_run_id")
    # The run row goes last: readers resolve a run before its clusters and members.
    store.replace_runs(root, "similarity_cluster_run", run, gone, "id")
    dropped = [r["id"] for r in gone.filter(F.col("id") != head["id"]).collect()]
    store.drop_runs(spark, root, "similarity_attribution", dropped, F.col("report_date") == head["report_date"])
    store.drop_runs(spark, root, "similarity_baseline_centroids", dropped, F.col("cluster_run_id").isin(dropped))
    if mode == "full":
        # A run's centroids are one partition, so saving it again replaces them.
        write_table(long.withColumns(stamp).filter("value <> 0"), root, "similarity_baseline_centroids", "overwrite")
        store.replace(
            root,
            "similarity_cluster_baseline",
            run.withColumns({**stamp, "feature_type": F.lit(feature_type)}).withColumn(
                "k_search_results", F.lit(json.dumps(searched) if searched else None)
            ),
        )


def attribute_run(
    spark: SparkSession,
    root: str,
    report_date: date,
    start: date,
    end: date,
    algorithm: str = "kmeans-asset",
    k: int | None = None,
    product_type_filter: str | None = None,
    benchmark: str = "cluster_avg",
    benchmark_code: str | None = None,
    now: datetime | None = None,
    save: bool = True,
) -> DataFrame:
    """Brinson attribution of every cluster of a stored run, in one job."""
    if benchmark not in ("cluster_avg", "index"):
        raise ValueError(f"unsupported benchmark: {benchmark}")
    if benchmark == "index" and not benchmark_code:
        raise ValueError("an index benchmark needs its code")
    found = runs.find_run(
        read_table(spark, root, "similarity_cluster_run"), report_date, algorithm, k, product_type_filter
    ).first()
    if found is None:
        raise ValueError(f"no cluster run for {report_date}, {algorithm}, k={k}")
    members = read_table(spark, root, "similarity_cluster_members").filter(
        (F.col("report_date") == report_date) & (F.col("cluster_run_id") == found["id"])
    )
    held = read_table(spark, root, "product_holding").filter(F.col("report_date") == report_date)
    industries = holdings.security_industries(read_table(spark, root, "holding_security_info"))
    returns = timeseries.asof_returns(read_table(spark, root, "market_quote"), F.lit(start), F.lit(end))
    index = None
    if benchmark == "index":
        index = attribution.index_weights(read_table(spark, root, "index_constituent_weight"), benchmark_code)
    results = attribution.brinson(members, held, industries, returns, index).withColumns(
        {
            "cluster_run_id": F.lit(found["id"]),
            "report_date": F.lit(report_date),
            "start_date": F.lit(start),
            "end_date": F.lit(end),
            "benchmark_type": F.lit(benchmark),
            "benchmark_code": F.lit(benchmark_code).cast("string"),
            "created_at": F.lit(now or datetime.utcnow()).cast("timestamp_ntz"),
        }
    )
    results = cut_lineage(results)
    if save:
        store.replace(root, "similarity_attribution", results)
    return results


def latest_report_date(spark: SparkSession, root: str) -> date:
    """Newest report date with holdings."""
    newest = read_table(spark, root, "product_holding").agg(F.max("report_date")).first()[0]
    if newest is None:
        raise ValueError("no holdings stored, so there is no report date")
    return newest


def analyse(
    spark: SparkSession,
    root: str,
    start: date,
    end: date,
    report_date: date | None = None,
    settings: Settings = Settings(),
    feature_type: str = "asset",
    mode: str = "auto",
    benchmark: str = "cluster_avg",
    benchmark_code: str | None = None,
    index_weights: DataFrame | None = None,
    quotes: DataFrame | None = None,
    arrival: Sequence[str] = ("created_at", "id"),
    now: datetime | None = None,
) -> dict[str, Any]:
    """Upsert landed weights and quotes, cluster the report date, attribute all clusters.

    ``arrival`` orders the landed rows; of one key the last wins.
    """
    day = report_date or latest_report_date(spark, root)
    if index_weights is not None:
        store.upsert(root, "index_constituent_weight", index_weights, arrival, keep=("id", "created_at"))
    if quotes is not None:
        store.upsert(root, "market_quote", quotes, arrival, keep=("id", "created_at"))
    out = cluster(spark, root, day, settings, feature_type, mode, now)
    out["attribution"] = attribution.attribution_totals(
        attribute_run(
            spark, root, day, start, end, out["algorithm"], out["k"],
            benchmark=benchmark, benchmark_code=benchmark_code, now=now,
        )
    )
    return out
