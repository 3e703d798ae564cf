"""Market exposure of cluster holdings and the index overlay chosen from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.text import bundle_key, infer_market_web, label
from holdscope.operators.latest import latest_quotes
from holdscope.operators.skew import top_rows
from holdscope.operators.timeseries import quote_history
from holdscope.session import cut_lineage


def market_breakdown(top_holdings: DataFrame, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Weight by inferred market; codes that are empty and weights that are not positive drop out."""
    usable = top_holdings.filter(
        F.col("asset_code").isNotNull() & (F.col("asset_code") != "") & (F.coalesce("weight", F.lit(0.0)) > 0)
    )
    return (
        usable.groupBy(*keys, infer_market_web(F.col("asset_code")).alias("market"))
        .agg(F.sum("weight").alias("weight"))
        .withColumn("label", label(F.col("market"), C.BREAKDOWN_LABELS))
    )


def overlay_symbols(breakdown: DataFrame, clusters: DataFrame) -> DataFrame:
    """Index symbols to draw for each cluster: (cluster_id, symbol_code, weight).

    Every cluster gets the baseline index. The bundle of its heaviest known market is added,
    and the domestic bundle when it holds both domestic and foreign assets. The weight is that
    of the market inferred from the first six characters of the index code.
    """
    known = breakdown.filter(F.col("market") != "UNKNOWN")
    dominant = top_rows(known, ["cluster_id"], [F.col("weight").desc(), F.col("market").asc()]).select(
        "cluster_id", bundle_key(F.col("market")).alias("bundle")
    )
    mixed = (
        known.groupBy("cluster_id")
        .agg(
            F.max(F.col("market").isin("HK", "US")).alias("abroad"),
            F.max(F.col("market").isin("SH", "SZ", "BJ")).alias("home"),
        )
        .filter("abroad AND home")
        .select("cluster_id", F.lit("domestic").alias("bundle"))
    )
    bundles = F.create_map(
        *[x for name, codes in C.INDEX_BUNDLES.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in codes]))]
    )
    added = dominant.unionByName(mixed).select(
        "cluster_id", F.explode(F.try_element_at(bundles, F.col("bundle"))).alias("symbol_code")
    )
    baseline = clusters.select("cluster_id", F.lit(C.BASELINE_INDEX).alias("symbol_code"))
    picks = baseline.unionByName(added).distinct()
    inferred = infer_market_web(F.substring("symbol_code", 1, 6))
    weights = breakdown.select("cluster_id", F.col("market").alias("_m"), "weight")
    return (
        picks.withColumn("_m", inferred)
        .join(weights, ["cluster_id", "_m"], "left")
        .select("cluster_id", "symbol_code", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    )


def market_overlay(
    breakdown: DataFrame, clusters: DataFrame, quotes: DataFrame, days: int = 60, end: Column | None = None
) -> DataFrame:
    """Overlay series of each cluster: the last ``days`` closes of every chosen index.

    Only indexes the market view shows (latest quote present, index or commodity) are drawn.
    """
    # At most a handful of markets per cluster, read by every step of the choice.
    breakdown = cut_lineage(breakdown)
    shown = latest_quotes(quotes, asset_classes=C.DEFAULT_MARKET_CLASSES).select(
        "symbol_code", "symbol_name", "market_region"
    )
    picks = cut_lineage(overlay_symbols(breakdown, clusters).join(shown, "symbol_code"))
    series = quote_history(quotes, picks.select("symbol_code").distinct(), days, end)
    return picks.join(series, "symbol_code")
