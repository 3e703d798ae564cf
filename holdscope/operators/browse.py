"""Filters, pages, lookups and menus of the browse layer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.parsing import page_number, page_size
from holdscope.functions.text import match_any
from holdscope.operators.latest import PRODUCT, latest_value, report_history
from holdscope.operators.skew import attach, top_rows


def all_of(predicates: Sequence[Column]) -> Column:
    """AND of the given predicates; none means every row."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def equals(**wanted: Any) -> Column:
    """Equality on every column that was given a value."""
    return all_of([F.col(c) == v for c, v in wanted.items() if v not in (None, "")])


def page(df: DataFrame, order: Sequence[Column], number: int | None = 1, size: int | None = 25) -> DataFrame:
    """One page of a totally ordered result."""
    size = page_size(size)
    return df.orderBy(*order).offset((page_number(number) - 1) * size).limit(size)


def page_total(df: DataFrame, size: int | None = 25) -> DataFrame:
    """Row total and page count (an empty result still has one page)."""
    size = page_size(size)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("bigint").alias("pages")
    )


def capped(df: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows in order, each flagged when more rows existed."""
    lines = df.orderBy(*order).limit(cap + 1)
    n = lines.agg((F.count(F.lit(1)) > cap)).scalar()
    return lines.withColumn("truncated", n).orderBy(*order).limit(cap)


def search_products(
    products: DataFrame,
    nav: DataFrame,
    institution: str | None = None,
    product_type: str | None = None,
    risk: str | None = None,
    keyword: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Products that pass the given filters, each with its latest NAV."""
    wanted = [
        equals(
            institution_code=institution,
            product_type=product_type,
            risk_level_standard=risk,
            status=status,
        )
    ]
    if keyword:
        wanted.append(match_any([F.col("product_code"), F.col("product_name")], keyword))
    hits = products.filter(all_of(wanted))
    # Only the values of the hits are reduced.
    theirs = nav.join(hits.select("product_id"), "product_id", "left_semi")
    last = latest_value(theirs, "product_id", "nav_date", ["unit_nav"], tiebreak="id")
    return hits.join(last, "product_id", "left").select(
        "product_id",
        *PRODUCT,
        "product_name",
        "product_type",
        "risk_level_standard",
        "status",
        "nav_date",
        "unit_nav",
    )


def search_holdings(
    holdings: DataFrame,
    products: DataFrame,
    reports: DataFrame,
    asset_type: str | None = None,
    market: str | None = None,
    institution: str | None = None,
    keyword: str | None = None,
    min_weight_percent: float | None = None,
    only_top10: bool = False,
    report_date: Any = None,
) -> DataFrame:
    """Holdings across products that pass the given filters, with product and report columns."""
    wanted = [equals(asset_type=asset_type, market=market, report_date=report_date)]
    if keyword:
        columns = [F.col("asset_code"), F.col("asset_name"), F.col("industry_name")]
        wanted.append(match_any(columns, keyword))
    if min_weight_percent is not None:
        wanted.append(F.col("weight") >= min_weight_percent / 100.0)
    if only_top10:
        wanted.append(F.col("is_top10"))
    who = products.filter(equals(institution_code=institution)).select(
        "product_id", *PRODUCT, "product_name"
    )
    periods = reports.select("report_id", "report_period")
    hits = holdings.filter(all_of(wanted))
    named = attach(hits, who, ["product_id"], "inner")
    return attach(named, periods, ["report_id"], "left")


def holding_order() -> list[Column]:
    """Heaviest first, then newest, then source order; the rest makes the order total."""
    return [
        F.col("weight").desc_nulls_last(),
        F.col("report_date").desc(),
        F.col("sort_order").asc_nulls_last(),
        F.col("product_id").asc(),
        F.col("asset_code").asc_nulls_last(),
    ]


def report_holdings(
    holdings: DataFrame, report_id: Any, asset_type: str | None = None, only_top10: bool = False
) -> DataFrame:
    """Holdings of one report in source order."""
    rows = holdings.filter(F.col("report_id") == report_id).filter(equals(asset_type=asset_type))
    if only_top10:
        rows = rows.filter(F.col("is_top10"))
    return rows.orderBy(
        F.col("sort_order").asc_nulls_last(),
        F.col("weight").desc_nulls_last(),
        F.col("asset_name").asc(),
    )


def with_security(holdings: DataFrame, securities: DataFrame) -> DataFrame:
    """Holdings with their security reference row; an unset market looks up ``UNKNOWN``."""
    info = securities.select(
        "asset_code",
        F.col("market").alias("_market"),
        F.col("asset_name").alias("security_name"),
        F.col("industry_name").alias("security_industry"),
    )
    rows = holdings.withColumn("_market", F.coalesce("market", F.lit("UNKNOWN")))
    return attach(rows, info, ["asset_code", "_market"], "left").drop("_market")


def security_info(securities: DataFrame, code: str, market: str | None = None) -> DataFrame:
    """Reference row of a code, optionally on one market."""
    return securities.filter(equals(asset_code=code, market=market)).orderBy("market").limit(1)


def by_key(df: DataFrame, key: str, value: Any) -> DataFrame:
    """Point lookup."""
    return df.filter(F.col(key) == value).limit(1)


def sorted_list(
    df: DataFrame, where: Column, order: Sequence[Column], limit: int | None = None
) -> DataFrame:
    """Rows of one owner in order: NAV, returns, fees, tags, logs, allocations."""
    rows = df.filter(where).orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def product_detail(
    products: DataFrame,
    reports: DataFrame,
    summaries: DataFrame,
    holdings: DataFrame,
    securities: DataFrame,
    report_id: Any = None,
) -> DataFrame:
    """Holdings shown on each product's page: its latest (or the chosen) report, with names.

    ``report_id`` falls back to the latest report for products that do not own it.
    """
    history = report_history(reports, products, summaries)
    chosen = F.lit(0) if report_id is None else (F.col("report_id") == report_id).cast("int")
    shown = top_rows(
        history.withColumn("_chosen", chosen),
        PRODUCT,
        [F.col("_chosen").desc(), F.col("report_date").desc(), F.col("report_id").desc()],
    ).select(*PRODUCT, "report_id", "report_period", "holding_count", "top10_weight")
    rows = attach(holdings, shown, ["report_id"], "inner")
    return with_security(rows, securities)


def tags_by_dimension(tags: DataFrame) -> DataFrame:
    """Style tags of a report per dimension; the dimensions and tags come from a fixed menu."""
    return tags.groupBy("product_id", "report_date", "dimension").agg(
        F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags")
    )


def menu(df: DataFrame, column: str, limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Distinct values of a column for a filter menu."""
    values = df.select(column).distinct()
    order = F.col(column).desc() if newest_first else F.col(column).asc()
    values = values.orderBy(order)
    return values if limit is None else values.limit(limit)


def best_names(securities: DataFrame) -> DataFrame:
    """One name per code; SH, SZ, BJ and HK rows go before any other market."""
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(m) for m in C.MARKET_PRIORITY]), F.col("market")), F.lit(0)),
        F.lit(len(C.MARKET_PRIORITY) + 1),
    )
    picked = top_rows(
        securities.withColumn("_rank", rank),
        ["asset_code"],
        [F.col("_rank").asc(), F.col("market").asc_nulls_last()],
    )
    return picked.select("asset_code", "asset_name")


def named_holdings(top_holdings: DataFrame, securities: DataFrame) -> DataFrame:
    """Cluster holdings with a display name: the security's, else the code, else a dash."""
    names = best_names(securities)
    return (
        top_holdings.join(names, "asset_code", "left")
        .withColumn("asset_name", F.coalesce("asset_name", "asset_code", F.lit("—")))
    )


def name_arrays(clusters: DataFrame, holdings: str, keys: Sequence[str], securities: DataFrame) -> DataFrame:
    """The keys and the stored holding array with a display name in each entry, in stored order.

    An entry without a code stays, shown as a dash. The arrays are short by definition (the top holdings
    of a cluster).
    """
    entries = clusters.select(*keys, F.posexplode_outer(holdings).alias("pos", "held"))
    named = named_holdings(entries.select(*keys, "pos", "held", F.col("held.asset_code").alias("asset_code")), securities)
    entry = F.struct("pos", "asset_code", "asset_name", F.col("held.weight").alias("weight"))
    lists = named.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("_list"))
    return lists.select(*keys, F.transform("_list", lambda x: x.dropFields("pos")).alias(holdings))
