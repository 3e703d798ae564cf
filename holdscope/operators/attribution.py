"""Brinson attribution by industry for all clusters in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.text import symbol_code
from holdscope.operators.latest import share_of
from holdscope.operators.skew import ranked, attach
from holdscope.session import cut_lineage


def priced(rows: DataFrame, industries: DataFrame, returns: DataFrame) -> DataFrame:
    """Holdings with return and industry; holdings without a quote drop out.

    Return and industry are joined into one small security table first, so the holdings are
    joined once; hot securities are split by the join.
    """
    codes = rows.select("asset_code", "market").distinct()
    lookup = (
        codes.withColumn("symbol_code", symbol_code(F.col("asset_code"), F.col("market")))
        .join(returns, "symbol_code")
        .join(industries, ["asset_code", "market"], "left")
        .select(
            "asset_code",
            "market",
            "stock_return",
            F.coalesce("industry_name", F.lit(C.UNKNOWN_INDUSTRY)).alias("industry_name"),
        )
    )
    return attach(rows, lookup, ["asset_code", "market"], "inner")


def industry_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weight and weighted return of each industry inside each key."""
    w = F.col("weight").cast("double")
    return rows.groupBy(*keys, "industry_name").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("stock_return")).alias("wr")
    )


def industry_profile(sums: DataFrame, keys: list[str], weight: str, ret: str) -> DataFrame:
    """Normalised weight and return of each industry inside each key.

    A key has at most one row per industry here, so its window is small.
    """
    r = F.when(F.col("w") > 0, F.col("wr") / F.col("w")).otherwise(0.0)
    return sums.select(*keys, "industry_name", share_of("w", keys).alias(weight), r.alias(ret))


def brinson(
    members: DataFrame,
    holdings: DataFrame,
    industries: DataFrame,
    returns: DataFrame,
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """Allocation, selection and interaction of every member of every cluster, ranked.

    The benchmark of a cluster is its pooled raw holdings, or ``benchmark`` constituents
    (asset_code, market, weight) for all clusters. Benchmark industries the product does not
    hold contribute only ``-Wb * Rb`` to allocation; their total is the benchmark return, so
    the product x industry grid is never built. Industries outside the benchmark drop out.
    """
    stock = holdings.filter((F.col("asset_type") == "stock") & F.col("weight").isNotNull()).select(
        "product_id", "asset_code", "market", "weight"
    )
    placed = attach(
        stock, members.select("product_id", "cluster_id"), ["product_id"], "inner"
    )
    # The holdings are read once: the pooled benchmark adds up the products' industry sums.
    sums = cut_lineage(industry_sums(priced(placed, industries, returns), ["cluster_id", "product_id"]))
    portfolio = industry_profile(sums, ["cluster_id", "product_id"], "wp", "rp")

    if benchmark is None:
        pooled = sums.groupBy("cluster_id", "industry_name").agg(F.sum("w").alias("w"), F.sum("wr").alias("wr"))
        bench = cut_lineage(industry_profile(pooled, ["cluster_id"], "wb", "rb"))
        on = ["cluster_id", "industry_name"]
        total = bench.groupBy("cluster_id").agg(F.sum(F.col("wb") * F.col("rb")).alias("bench"))
        portfolio = attach(portfolio, total, ["cluster_id"], "inner")
    else:
        index_rows = priced(benchmark.select("asset_code", "market", "weight"), industries, returns)
        index_sums = industry_sums(index_rows.withColumn("_all", F.lit(1)), ["_all"])
        bench = cut_lineage(industry_profile(index_sums, ["_all"], "wb", "rb").drop("_all"))
        on = ["industry_name"]
        # One number for all clusters; without priced constituents there is no result.
        total = bench.agg(F.sum(F.col("wb") * F.col("rb"))).scalar()
        portfolio = portfolio.withColumn("bench", total).filter(F.col("bench").isNotNull())

    joined = attach(portfolio, bench, on, "left")
    wp, rp, wb, rb = (F.col(c) for c in ("wp", "rp", "wb", "rb"))
    held = wb.isNotNull() & (wp != 0)
    zero = F.lit(0.0)
    effects = joined.groupBy("cluster_id", "product_id").agg(
        F.max("bench").alias("benchmark_return"),
        F.sum(F.when(held, wp * rp).otherwise(zero)).alias("total_return"),
        F.sum(F.when(held, wp * rb).otherwise(zero)).alias("_held"),
        F.sum(F.when(held, wb * (rp - rb)).otherwise(zero)).alias("selection_effect"),
        F.sum(F.when(held, (wp - wb) * (rp - rb)).otherwise(zero)).alias("interaction_effect"),
    )
    results = effects.select(
        "cluster_id",
        "product_id",
        "total_return",
        "benchmark_return",
        (F.col("total_return") - F.col("benchmark_return")).alias("excess_return"),
        (F.col("_held") - F.col("benchmark_return")).alias("allocation_effect"),
        "selection_effect",
        "interaction_effect",
    )
    # One row per product: written once, then read by the three steps of the ranking.
    return ranked(cut_lineage(results), ["cluster_id"], "excess_return", ["product_id"], out="rank_in_cluster")


def index_weights(weights: DataFrame, index_code: str, effective_date=None) -> DataFrame:
    """Constituents of an index on a date, or on its latest date."""
    rows = weights.filter(F.col("index_code") == index_code)
    day = rows.agg(F.max("effective_date")).scalar() if effective_date is None else F.lit(effective_date)
    return rows.filter(F.col("effective_date") == day).select(
        F.col("constituent_code").alias("asset_code"), "market", "weight", "effective_date"
    )


def attribution_totals(results: DataFrame) -> DataFrame:
    """Products attributed per cluster."""
    return results.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_products"))
