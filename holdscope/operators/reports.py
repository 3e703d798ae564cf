"""Counts, coverage and status reports."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.operators.latest import PRODUCT, latest_snapshot


def metric_rows(df: DataFrame, *columns: str) -> DataFrame:
    """One-row numbers as (metric, value) rows."""
    return df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in columns])
        )
    )


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def dashboard_totals(products: DataFrame, nav: DataFrame, holdings: DataFrame, reports: DataFrame) -> DataFrame:
    """Headline numbers as (metric, value) rows; each table is read once."""
    n = F.count(F.lit(1))
    parts = [
        metric_rows(
            products.agg(n.alias("product_total"), F.countDistinct("institution_code").alias("institution_total")),
            "product_total",
            "institution_total",
        ),
        metric_rows(nav.agg(n.alias("nav_total")), "nav_total"),
        metric_rows(
            holdings.agg(
                n.alias("holding_total"),
                F.countDistinct("product_id").alias("products_with_holding"),
                F.max("report_date").alias("latest_holding_date"),
            ),
            "holding_total",
            "products_with_holding",
            "latest_holding_date",
        ),
        metric_rows(reports.agg(n.alias("report_total")), "report_total"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_holding_institutions(products: DataFrame, holdings: DataFrame) -> DataFrame:
    """Institutions with holdings on the newest report date."""
    newest = holdings.agg(F.max("report_date")).scalar()
    ids = holdings.filter(F.col("report_date") == newest).select("product_id").distinct()
    return products.join(ids, "product_id", "left_semi").select("institution_code").distinct()


def holdings_by_institution(products: DataFrame, holdings: DataFrame) -> DataFrame:
    """Holding rows per institution; rows are counted per product before the join."""
    per_product = holdings.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_product.join(products.select("product_id", "institution_code"), "product_id")
        .groupBy("institution_code")
        .agg(F.sum("n").alias("count"))
    )


def last_success(logs: DataFrame) -> DataFrame:
    """The newest finished successful job."""
    return (
        logs.filter(F.col("status") == "success")
        .orderBy(F.col("end_time").desc_nulls_last(), F.col("id").desc())
        .limit(1)
        .select("job_name", "end_time")
    )


def recent_logs(logs: DataFrame, institution: str | None = None, limit: int = 10) -> DataFrame:
    rows = logs if institution is None else logs.filter(F.col("institution_code") == institution)
    return rows.orderBy(F.col("start_time").desc_nulls_last(), F.col("id").desc()).limit(limit)


def recent_failures(logs: DataFrame, now: Column, days: int = 7, limit: int = 10, width: int = 80) -> DataFrame:
    """Newest failed jobs of the last days, with a shortened message."""
    since = now - F.make_interval(days=F.lit(days))
    return (
        logs.filter((F.col("status") == "failed") & (F.col("created_at") > since))
        .orderBy(F.col("created_at").desc(), F.col("id").desc())
        .limit(limit)
        .select(
            "job_name",
            "institution_code",
            F.substring(F.coalesce("error_message", F.lit("")), 1, width).alias("error"),
            "created_at",
        )
    )


def market_totals(quotes: DataFrame) -> DataFrame:
    """Latest date and symbol count."""
    return quotes.agg(
        F.max("quote_date").alias("latest_date"), F.countDistinct("symbol_code").alias("symbol_count")
    )


def _with_product(facts: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct logical products that own any of the facts, over all their snapshots."""
    ids = facts.select("product_id").distinct()
    return products.select("product_id", *PRODUCT).join(ids, "product_id", "left_semi").select(*PRODUCT).distinct()


def coverage(products: DataFrame, nav: DataFrame, reports: DataFrame) -> DataFrame:
    """Products per institution, and how many have NAV and holdings on any of their snapshots."""
    latest = latest_snapshot(products).select(*PRODUCT)
    with_nav = _with_product(nav, products).withColumn("has_nav", F.lit(True))
    with_holding = _with_product(reports, products).withColumn("has_holding", F.lit(True))
    rows = latest.join(with_nav, [*PRODUCT], "left").join(with_holding, [*PRODUCT], "left")
    return rows.groupBy("institution_code").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("has_nav").isNotNull()).alias("with_nav"),
        F.count_if(F.col("has_holding").isNotNull()).alias("with_holding"),
    )


def collection_totals(
    products: DataFrame, nav: DataFrame, holdings: DataFrame, reports: DataFrame, quotes: DataFrame, today: Column
) -> DataFrame:
    """Numbers of the collection report as (metric, value) rows."""
    n = F.count(F.lit(1))
    recent = F.col("quote_date") >= F.date_sub(today, 2)
    parts = [
        products.agg(
            F.countDistinct(*[F.col(c) for c in PRODUCT]).alias("product_total"),
            F.max("collect_date").alias("latest_collect_date"),
        ),
        _with_product(nav, products).agg(n.alias("product_with_nav")),
        _with_product(reports, products).agg(n.alias("product_with_holding")),
        nav.agg(n.alias("nav_total")),
        holdings.agg(n.alias("holding_total")),
        quotes.agg(
            n.alias("market_quote_total"),
            F.max("quote_date").alias("market_quote_latest_date"),
            F.countDistinct(F.when(recent, F.col("symbol_code"))).alias("market_quote_symbol_count"),
        ),
    ]
    out = None
    for p in parts:
        rows = metric_rows(p, *p.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def advice(totals: DataFrame, expected_symbols: int, failed_tasks: int = 0) -> DataFrame:
    """Advice lines that follow from the collection numbers, in a fixed order."""

    def number(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("value").cast("bigint")))

    products = number("product_total")
    checks = (
        ("nav", products - number("product_with_nav")),
        ("holding", products - number("product_with_holding")),
        ("symbols", F.lit(expected_symbols) - number("market_quote_symbol_count")),
        ("tasks", F.lit(failed_tasks).cast("bigint")),
    )
    lines = totals.agg(
        F.filter(
            F.array(*[F.when(gap > 0, F.format_string(C.ADVICE[name], gap)) for name, gap in checks]),
            lambda x: x.isNotNull(),
        ).alias("lines")
    )
    some = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.lit(C.ADVICE["fine"])))
    return lines.select(F.posexplode(some).alias("position", "advice"))


def missing_symbols(expected: DataFrame, quotes: DataFrame, since: Column) -> DataFrame:
    """Expected symbols without a quote on or after a date; none means the collection can skip."""
    present = quotes.filter(F.col("quote_date") >= since).select("symbol_code").distinct()
    return expected.join(present, "symbol_code", "left_anti")


def source_status(status: DataFrame) -> DataFrame:
    """Symbols per source with success and failure counts; sourceless rows count as failed."""
    ok = F.col("status") == "success"
    return status.groupBy(F.coalesce("source", F.lit("failed")).alias("source")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
    )


def holding_symbols(holdings: DataFrame, report_date: Any) -> DataFrame:
    """Distinct stocks held on a date, each with its greatest name."""
    rows = holdings.filter((F.col("report_date") == report_date) & (F.col("asset_type") == "stock"))
    return rows.groupBy("asset_code", "market").agg(F.max("asset_name").alias("asset_name"))


def holding_share(products: DataFrame, holdings: DataFrame) -> DataFrame:
    """Share of product rows that have holdings, as one-decimal percent text."""
    held = holdings.agg(F.countDistinct("product_id")).scalar()
    share = F.try_divide(held.cast("double"), F.count(F.lit(1)))
    return products.agg(F.concat(F.format_string("%.1f", F.coalesce(share, F.lit(0.0)) * 100.0), F.lit("%")).alias("share"))
