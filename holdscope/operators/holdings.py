"""From holdings to weight features: cross-section, share classes, industries, norms."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.functions import constants as C
from holdscope.functions.text import base_name, has_share_class, infer_market
from holdscope.operators.latest import latest_snapshot
from holdscope.operators.skew import attach, top_rows
from holdscope.session import cut_lineage, materialise

META = ("product_id", "product_code", "product_name", "institution_code", "product_type")


def cross_section(
    products: DataFrame,
    holdings: DataFrame,
    report_date: Any,
    product_types: Sequence[str] = ("equity", "mixed"),
    asset_types: Sequence[str] = ("stock",),
    min_holdings: int = 3,
) -> DataFrame:
    """Weighted holdings of the latest snapshot of each product that reported on the date.

    A snapshot competes only if it has holdings on the date; products need ``min_holdings``
    distinct assets of the wanted types. Snapshots are keyed by product code alone. Names and markets of
    the assets are passed on if the holdings have them.
    """
    on_date = holdings.filter(F.col("report_date") == report_date)
    wanted = F.col("asset_type").isin(*asset_types) & F.col("weight").isNotNull()
    # One pass finds both who reported at all and how many distinct assets qualify.
    reported = on_date.groupBy("product_id").agg(
        F.countDistinct(F.when(wanted, F.col("asset_code"))).alias("n")
    )
    candidates = products.filter(F.col("product_type").isin(*product_types)).join(reported, "product_id")
    latest = latest_snapshot(candidates, ["product_code"])
    kept = latest.filter(F.col("n") >= min_holdings).select(*META)
    told = [c for c in ("asset_name", "market") if c in holdings.columns]
    rows = on_date.filter(wanted).select("product_id", "asset_code", *told, F.col("weight").cast("double"))
    return attach(rows, kept, ["product_id"], "inner")


def share_class_map(rows: DataFrame) -> DataFrame:
    """Which product stands for which: one row per (kept_id, merged_id).

    Products of one institution with the same base name merge when at least two of them carry
    a share-class letter; the one with most holding rows is kept, ties to the lowest id. All
    members of such a group merge, also those without a letter. Long form, so a huge family
    is rows, not one list.
    """
    products = materialise(
        rows.groupBy("institution_code", "product_name", "product_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("family", base_name(F.col("product_name")))
        .withColumn("lettered", has_share_class(F.col("product_name")).cast("int"))
        .groupBy("institution_code", "family", "product_id")
        .agg(F.sum("rows").alias("holding_count"), F.max("lettered").alias("lettered")),
        "families",
    )
    family = ["institution_code", "family"]
    merging = (
        products.groupBy(*family)
        .agg(F.sum("lettered").alias("letters"))
        .filter("letters >= 2")
        .select(*family)
    )
    keep = (
        top_rows(products, family, [F.col("holding_count").desc(), F.col("product_id").asc()])
        .join(merging, family, "left_semi")
        .select(*family, F.col("product_id").alias("_keep"))
    )
    return attach(products, keep, family).select(
        F.coalesce("_keep", "product_id").alias("kept_id"), F.col("product_id").alias("merged_id")
    )


def keep_share_classes(rows: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Holdings of kept products only."""
    kept = merge_map.filter("kept_id = merged_id").select(F.col("kept_id").alias("product_id"))
    return rows.join(kept, "product_id", "left_semi")


def asset_cells(rows: DataFrame) -> DataFrame:
    """Weight per (product, asset code); the market is not part of the key."""
    known = rows.filter(F.col("asset_code").isNotNull())
    return known.groupBy("product_id", F.col("asset_code").alias("feature")).agg(
        F.sum("weight").alias("raw_weight")
    )


def security_industries(securities: DataFrame) -> DataFrame:
    """(asset_code, market) to industry, also under the market inferred from the code.

    A row stored under its own market wins over one filed under an inferred market.
    """
    known = securities.filter(F.col("industry_name").isNotNull()).select(
        "asset_code", "market", "industry_name"
    )
    inferred = infer_market(F.col("asset_code"))
    own = known.withColumn("market", F.coalesce("market", inferred)).withColumn("_rank", F.lit(0))
    extra = (
        known.withColumn("_own", F.coalesce("market", inferred))
        .filter(F.col("_own") != inferred)
        .select("asset_code", inferred.alias("market"), "industry_name")
        .withColumn("_rank", F.lit(1))
    )
    return top_rows(
        own.unionByName(extra), ["asset_code", "market"], [F.col("_rank").asc(), F.col("industry_name").asc()]
    ).drop("_rank")


def with_industry(rows: DataFrame, industries: DataFrame) -> DataFrame:
    """Rows with the industry of (asset_code, market); anything unmapped is "unknown"."""
    found = attach(rows, industries, ["asset_code", "market"], "left")
    return found.withColumn("industry_name", F.coalesce("industry_name", F.lit(C.UNKNOWN_INDUSTRY)))


def industry_cells(rows: DataFrame, industries: DataFrame) -> DataFrame:
    """Weight per (product, industry). Rows without a market have no group and drop out.

    Weights are summed per (asset, market) first, so the lookup joins once per distinct
    holding and the hot assets are already combined.
    """
    known = rows.filter(F.col("asset_code").isNotNull() & F.col("market").isNotNull())
    per_asset = known.groupBy("product_id", "asset_code", "market").agg(F.sum("weight").alias("weight"))
    return (
        with_industry(per_asset, industries)
        .groupBy("product_id", F.col("industry_name").alias("feature"))
        .agg(F.sum("weight").alias("raw_weight"))
    )


def industry_weights(rows: DataFrame, industries: DataFrame) -> DataFrame:
    """Industry weights with an unset market filled from the code, heaviest first per product."""
    filled = rows.withColumn("market", F.coalesce("market", infer_market(F.col("asset_code"))))
    return industry_cells(filled, industries).orderBy("product_id", F.col("raw_weight").desc(), "feature")


def with_positions(weights: DataFrame) -> DataFrame:
    """Position of each industry inside its product, heaviest first; a product holds few industries."""
    heaviest = Window.partitionBy("product_id").orderBy(F.col("raw_weight").desc(), F.col("feature").asc())
    return weights.withColumn("position", F.row_number().over(heaviest))


def l2_normalised(cells: DataFrame) -> DataFrame:
    """Cells with a unit-length weight next to the raw one; a zero vector stays zero.

    A window over the product reads the cells once, where a join with the norms would derive them twice.
    """
    norm = F.sqrt(F.sum(F.col("raw_weight") * F.col("raw_weight")).over(Window.partitionBy("product_id")))
    joined = cells.withColumn("_norm", norm)
    weight = F.when(F.col("_norm") == 0, F.col("raw_weight")).otherwise(F.col("raw_weight") / F.col("_norm"))
    return joined.withColumn("weight", weight).drop("_norm")


def features(
    rows: DataFrame,
    feature_type: str = "asset",
    industries: DataFrame | None = None,
    deduplicate: bool = True,
    normalize: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Sparse feature table (product_id, feature, raw_weight, weight) and the merge map."""
    merge_map = None
    if deduplicate:
        # The cross-section feeds both the merge map and the cells.
        rows = cut_lineage(rows)
        merge_map = share_class_map(rows)
        rows = keep_share_classes(rows, merge_map)
    if feature_type == "asset":
        cells = asset_cells(rows)
    elif feature_type == "industry":
        if industries is None:
            raise ValueError("industry features need an industry mapping")
        cells = industry_cells(rows, industries)
    else:
        raise ValueError(f"unknown feature type: {feature_type}")
    if normalize:
        return l2_normalised(cells), merge_map
    return cells.withColumn("weight", F.col("raw_weight")), merge_map


def to_matrix(cells: DataFrame, names: Sequence[str], value: str = "raw_weight") -> DataFrame:
    """Wide product x feature table for export, absent cells zero; ``names`` bounds the width."""
    return cells.groupBy("product_id").pivot("feature", list(names)).agg(F.sum(value)).na.fill(0.0)


def concentration(cells: DataFrame) -> DataFrame:
    """Sum of squared raw weights of each product."""
    return cells.groupBy("product_id").agg(
        F.sum(F.col("raw_weight") * F.col("raw_weight")).alias("hhi")
    )


def resolved_industries(securities: DataFrame, industries: DataFrame) -> DataFrame:
    """Industry found for each security and whether that changes it.

    Looks under the stored market, then the inferred market, then, for four-digit HK codes,
    under the code with a leading zero.
    """
    code = F.col("asset_code")
    own = F.coalesce(F.nullif(F.col("market"), F.lit("")), infer_market(code))
    base = securities.withColumns({"_own": own, "_inferred": infer_market(code)})

    def source(name: str) -> DataFrame:
        return industries.select(
            F.col("asset_code").alias("_code"), F.col("market").alias("_m"), F.col("industry_name").alias(name)
        )

    hk = (F.col("_own") == "HK") & (F.length(code) == 4)
    tries = (
        ("_i1", code, F.col("_own")),
        ("_i2", code, F.col("_inferred")),
        ("_i3", F.when(hk, F.concat(F.lit("0"), code)), F.lit("HK")),
    )
    for name, key, market in tries:
        found = source(name)
        base = base.join(found, (key == found["_code"]) & (market == found["_m"]), "left").drop("_code", "_m")
    new = F.coalesce("_i1", "_i2", "_i3")
    outcome = (
        F.when(new.isNull(), "missing")
        .when(F.col("industry_name").eqNullSafe(new), "unchanged")
        .otherwise("updated")
    )
    return base.select(
        *securities.columns, F.coalesce(new, F.col("industry_name")).alias("new_industry"), outcome.alias("outcome")
    )


def industry_update_counts(resolved: DataFrame) -> DataFrame:
    """Totals of an industry refresh."""
    o = F.col("outcome")
    return resolved.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(o == "updated").alias("updated"),
        F.count_if(o == "unchanged").alias("unchanged"),
        F.count_if(o == "missing").alias("missing"),
    )
