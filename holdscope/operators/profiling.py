"""Cluster profiles: top holdings and industries, concentration, overlap, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.functions import constants as C
from holdscope.functions.text import cluster_label, infer_market
from holdscope.operators.holdings import concentration
from holdscope.operators.similarity import mean_pairwise_overlaps


def _ordered(name: str, n: int) -> Column:
    """At most ``n`` (name, weight) structs in rank order."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", F.col("feature").alias(name), F.col("value").alias("weight"))))
    return F.transform(F.slice(pairs, 1, n), lambda p: F.struct(p[name].alias(name), p["weight"].alias("weight")))


def top_features(centroids: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest features of each cluster, then the positive ones of those, with rank.

    The cut comes before the sign filter, so fewer than ``n`` rows may remain. Equal weights
    order by feature name.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.col("value").desc(), F.col("feature").asc())
    ranked = centroids.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return ranked.filter(F.col("value") > 0)


def industries_of_assets(centroids: DataFrame, industries: DataFrame, n: int = 5) -> DataFrame:
    """Positive centroid asset weights summed by industry, the ``n`` heaviest per cluster."""
    rows = centroids.filter(F.col("value") > 0).select(
        "cluster_id",
        F.col("feature").alias("asset_code"),
        infer_market(F.col("feature")).alias("market"),
        "value",
    )
    named = rows.join(industries, ["asset_code", "market"], "left")
    sums = named.groupBy(
        "cluster_id", F.coalesce("industry_name", F.lit(C.UNKNOWN_INDUSTRY)).alias("feature")
    ).agg(F.sum("value").alias("value"))
    w = Window.partitionBy("cluster_id").orderBy(F.col("value").desc(), F.col("feature").asc())
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def institution_counts(labels: DataFrame, products: DataFrame) -> DataFrame:
    """Members per cluster and institution."""
    who = products.select("product_id", "institution_code")
    return labels.join(who, "product_id").groupBy("cluster_id", "institution_code").agg(
        F.count(F.lit(1)).alias("products")
    )


def share_merge_ratio(labels: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Products folded into the members of each cluster, relative to its size."""
    merged = merge_map.groupBy(F.col("kept_id").alias("product_id")).agg(F.count(F.lit(1)).alias("m"))
    rows = labels.join(merged, "product_id", "left")
    n = F.count(F.lit(1))
    return rows.groupBy("cluster_id").agg(
        ((F.sum(F.coalesce("m", F.lit(1))) - n) / n).alias("ac_share_dominance_ratio")
    )


def representatives(distances: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` members closest to their centroid, with rank; ties to the lowest id.

    Distances compare at nine decimals: the two members of a pair are equally far from their
    mean, and the order of a distributed sum must not decide between them.
    """
    near = F.round("distance_to_center", 9).asc()
    w = Window.partitionBy("cluster_id").orderBy(near, F.col("product_id").asc())
    return distances.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def build_profiles(
    cells: DataFrame,
    labels: DataFrame,
    centroids: DataFrame,
    distances: DataFrame,
    products: DataFrame,
    merge_map: DataFrame | None = None,
    industries: DataFrame | None = None,
    feature_type: str = "asset",
    top_holdings: int = 10,
    top_industries: int = 5,
    max_representatives: int = 5,
) -> DataFrame:
    """One profile row per cluster.

    ``centroids`` is (cluster_id, feature, value). Asset clusters get industries through
    ``industries``; without it each top asset stands as its own industry. Industry clusters
    show their industries as holdings.
    """
    n_first = top_industries if feature_type == "industry" else top_holdings
    top = top_features(centroids, n_first)
    holdings = top.groupBy("cluster_id").agg(_ordered("asset_code", top_holdings).alias("top_holdings"))
    if feature_type == "industry":
        named = top
    elif industries is not None:
        named = industries_of_assets(centroids, industries, top_industries)
    else:
        named = top.filter(F.col("rank") <= top_industries).withColumn(
            "feature", F.concat(F.lit("asset:"), "feature")
        )
    inds = named.groupBy("cluster_id").agg(_ordered("industry", top_industries).alias("top_industries"))

    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    hhi = labels.join(concentration(cells), "product_id").groupBy("cluster_id").agg(F.avg("hhi").alias("avg_hhi"))
    # One entry per institution: a fixed, short list.
    places = institution_counts(labels, products).groupBy("cluster_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("institution_code", "products")))).alias(
            "institution_distribution"
        )
    )
    picked = representatives(distances, max_representatives).join(
        products.select("product_id", "product_code", "product_name"), "product_id"
    )
    order = F.sort_array(F.collect_list(F.struct("rank", "product_id", "product_code", "product_name")))
    reps = picked.groupBy("cluster_id").agg(order.alias("_r")).select(
        "cluster_id",
        F.transform("_r", lambda r: r["product_id"]).alias("representative_products"),
        F.transform("_r", lambda r: r["product_code"]).alias("representative_codes"),
        F.transform("_r", lambda r: r["product_name"]).alias("representative_names"),
    )
    clusters = centroids.select("cluster_id").distinct()
    out = clusters
    parts = [
        sizes,
        holdings,
        inds,
        hhi,
        mean_pairwise_overlaps(cells, labels, {"weight": "avg_overlap", "raw_weight": "avg_overlap_raw"}),
        places,
        reps,
    ]
    if merge_map is not None:
        parts.append(share_merge_ratio(labels, merge_map))
    for part in parts:
        out = out.join(part, "cluster_id", "left")
    if merge_map is None:
        out = out.withColumn("ac_share_dominance_ratio", F.lit(0.0))
    zero = F.lit(0.0)
    return out.withColumns(
        {
            "size": F.coalesce("size", F.lit(0)),
            "avg_hhi": F.coalesce("avg_hhi", zero),
            "avg_overlap": F.coalesce("avg_overlap", zero),
            "avg_overlap_raw": F.coalesce("avg_overlap_raw", zero),
            "ac_share_dominance_ratio": F.coalesce("ac_share_dominance_ratio", zero),
            "cluster_label": cluster_label(F.col("top_industries")),
        }
    )


def industry_matrix(top_industries: DataFrame, cluster_ids: list[int], rows: int = 20) -> DataFrame:
    """Industry x cluster table of the heaviest industries over all clusters.

    ``top_industries`` is (cluster_id, industry, weight); the columns are the run's clusters.
    Industries order by their largest weight.
    """
    peak = (
        top_industries.groupBy("industry")
        .agg(F.max("weight").alias("peak"))
        .orderBy(F.col("peak").desc(), "industry")
        .limit(rows)
    )
    wide = top_industries.groupBy("industry").pivot("cluster_id", cluster_ids).agg(F.max("weight"))
    return wide.join(peak, "industry").orderBy(F.col("peak").desc(), "industry")
