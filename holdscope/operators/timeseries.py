"""Windows over price and NAV series: histories, period changes, composites, as-of returns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators.latest import PRODUCT
from holdscope.operators.skew import attach, exact_median, ranked, top_rows
from holdscope.session import cut_lineage


def in_window(date: str, end: Column, days: int) -> Column:
    """Calendar window of ``days`` days that ends on ``end``, both ends included."""
    return F.col(date).between(F.date_sub(end, days), end)


def trailing_window(quotes: DataFrame, days: int = 60, date: str = "quote_date") -> DataFrame:
    """Rows of the last ``days`` calendar days before the newest date present."""
    last = quotes.agg(F.max(date)).scalar()
    return quotes.filter(in_window(date, last, days))


def quote_history(
    quotes: DataFrame, symbols: DataFrame | None = None, days: int = 30, end: Column | None = None
) -> DataFrame:
    """The last ``days`` rows (not calendar days) of each symbol up to ``end``, ascending.

    With ``symbols`` given, requested symbols without rows stay with a NULL date.
    """
    rows = quotes if end is None else quotes.filter(F.col("quote_date") <= end)
    if symbols is not None:
        rows = rows.join(symbols.select("symbol_code"), "symbol_code", "left_semi")
    kept = top_rows(rows, ["symbol_code"], [F.col("quote_date").desc()], days).select(
        "symbol_code", "quote_date", "close_price"
    )
    if symbols is not None:
        kept = symbols.select("symbol_code").join(kept, "symbol_code", "left")
    return kept.orderBy("symbol_code", "quote_date")


def window_coverage(quotes: DataFrame, start: Any, end: Any) -> DataFrame:
    """Row count and date range per symbol inside a window."""
    return (
        quotes.filter(F.col("quote_date").between(start, end))
        .groupBy("symbol_code")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.min("quote_date").alias("first_date"),
            F.max("quote_date").alias("last_date"),
        )
    )


def asof_returns(quotes: DataFrame, start: Column, end: Column, lookback_days: int = 5) -> DataFrame:
    """Simple return per symbol between the last closes on or before two dates.

    Each endpoint looks back at most ``lookback_days`` calendar days. One pass: both closes
    come out of the same aggregate, which combines on the map side.
    """
    day, close = F.col("quote_date"), F.col("close_price")
    near_start = in_window("quote_date", start, lookback_days)
    near_end = in_window("quote_date", end, lookback_days)
    ends = (
        quotes.filter(near_start | near_end)
        .groupBy("symbol_code")
        .agg(
            F.max(F.when(near_start, F.struct(day, close))).alias("s"),
            F.max(F.when(near_end, F.struct(day, close))).alias("e"),
        )
    )
    s, e = F.col("s.close_price").cast("double"), F.col("e.close_price").cast("double")
    return ends.filter((s > 0) & (e != 0)).select("symbol_code", (e / s - 1.0).alias("stock_return"))


def member_nav(members: DataFrame, products: DataFrame, nav: DataFrame, end: Column, days: int) -> DataFrame:
    """One NAV per (cluster, logical product, date) in the window, over all sibling snapshots.

    On a shared date the lowest snapshot id wins.
    """
    keys = products.select("product_id", *PRODUCT)
    logical = members.select("cluster_id", "product_id").join(keys, "product_id").select(
        "cluster_id", *PRODUCT
    ).distinct()
    siblings = keys.join(logical, [*PRODUCT])
    rows = nav.filter(in_window("nav_date", end, days)).select("product_id", "nav_date", "unit_nav")
    return (
        rows.join(siblings, "product_id")
        .groupBy("cluster_id", *PRODUCT, "nav_date")
        .agg(F.min(F.struct("product_id", "unit_nav")).getField("unit_nav").cast("double").alias("nav"))
    )


def member_values(
    members: DataFrame,
    products: DataFrame,
    nav: DataFrame,
    holdings: DataFrame,
    end: Column,
    days: int = 60,
) -> DataFrame:
    """First and last NAV, span and change of every cluster member, with its holding totals."""
    series = member_nav(members, products, nav, end, days)
    point = F.struct(F.col("nav_date"), F.col("nav"))
    span = series.groupBy("cluster_id", *PRODUCT).agg(
        F.min(point).alias("a"), F.max(point).alias("z"), F.count(F.lit(1)).alias("nav_record_count")
    )
    totals = holdings.groupBy("product_id").agg(
        F.sum("market_value").alias("holding_market_value"), F.sum("weight").alias("holding_weight")
    )
    who = products.select("product_id", *PRODUCT)
    rows = (
        members.select("cluster_id", "product_id")
        .join(who, "product_id")
        .join(span, ["cluster_id", *PRODUCT], "left")
        .join(totals, "product_id", "left")
    )
    moved = F.col("z.nav_date") != F.col("a.nav_date")
    change = F.try_divide(F.col("z.nav") - F.col("a.nav"), F.col("a.nav"))
    return rows.select(
        "cluster_id",
        "product_id",
        *PRODUCT,
        F.col("z.nav_date").alias("latest_nav_date"),
        F.col("z.nav").alias("latest_unit_nav"),
        F.col("a.nav_date").alias("earliest_nav_date"),
        F.col("a.nav").alias("earliest_unit_nav"),
        F.when(moved, F.datediff("z.nav_date", "a.nav_date")).alias("span_days"),
        F.coalesce("nav_record_count", F.lit(0)).alias("nav_record_count"),
        F.when(moved, change).alias("period_change_pct"),
        F.date_sub(end, days).alias("window_start"),
        end.alias("window_end"),
        F.coalesce("holding_market_value", F.lit(0.0)).alias("holding_market_value"),
        F.coalesce("holding_weight", F.lit(0.0)).alias("holding_weight"),
    )


def value_dispersion(rows: DataFrame, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Dispersion of the period change per cluster, with latest-NAV statistics."""
    # One row per member, read by the aggregate and by the ranking behind the median.
    rows = cut_lineage(rows.select(*keys, "product_id", "period_change_pct", "latest_unit_nav"))
    c, v = F.col("period_change_pct"), F.col("latest_unit_nav")
    stats = rows.groupBy(*keys).agg(
        F.count(c).alias("n"),
        F.avg(c).alias("mean_change"),
        F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0).alias("std_change"),
        F.min(c).alias("min_change"),
        F.max(c).alias("max_change"),
        (F.max(c) - F.min(c)).alias("range_pct"),
        F.avg((c > 0).cast("double")).alias("positive_share"),
        F.when(F.count(c) > 0, F.avg(v)).alias("mean_nav"),
        F.when(F.count(c) > 0, F.min(v)).alias("min_nav"),
        F.when(F.count(c) > 0, F.max(v)).alias("max_nav"),
    )
    mean, std = F.col("mean_change"), F.col("std_change")
    cv = F.when(mean == 0, 0.0).otherwise(F.try_divide(std, F.abs(mean)))
    medians = exact_median(rows, keys, "period_change_pct")
    return (
        stats.withColumn("coefficient_of_variation", cv)
        .join(medians.withColumnRenamed("median", "median_change"), list(keys), "left")
    )


def extreme_movers(rows: DataFrame, n: int = 5, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """The ``n`` members that rose most and the ``n`` that rose least, per cluster."""
    known = rows.filter(F.col("period_change_pct").isNotNull()).select(
        *keys, "product_id", "period_change_pct"
    )

    def side(name: str, order: Column, tie: Column) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order, tie)
        picked = known.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)
        return picked.withColumn("side", F.lit(name))

    change, pid = F.col("period_change_pct"), F.col("product_id")
    return side("top", change.desc(), pid.asc()).unionByName(side("bottom", change.asc(), pid.desc()))


def composite_series(
    members: DataFrame, products: DataFrame, nav: DataFrame, end: Column, days: int = 60
) -> DataFrame:
    """Equal-weight member average per date, rebased to 100 at the anchor, for every cluster.

    The anchor is the first date that covers 80 % of the cluster's members, else the first
    date. Raw levels are averaged without filling gaps; dates before the anchor are kept. A
    zero anchor leaves the series unrebased.
    """
    series = member_nav(members, products, nav, end, days)
    daily = series.groupBy("cluster_id", "nav_date").agg(
        F.avg("nav").alias("level"), F.count(F.lit(1)).alias("covered")
    )
    size = (
        members.join(products.select("product_id", *PRODUCT), "product_id")
        .groupBy("cluster_id")
        .agg(F.countDistinct(*[F.col(c) for c in PRODUCT]).alias("n_members"))
    )
    daily = daily.join(size, "cluster_id")
    need = F.greatest(F.lit(1), F.floor(F.col("n_members") * F.lit(0.8)))
    point = F.struct("nav_date", "level")
    anchor = daily.groupBy("cluster_id").agg(
        F.coalesce(F.min(F.when(F.col("covered") >= need, point)), F.min(point)).alias("anchor")
    )
    base = F.col("anchor.level")
    return daily.join(anchor, "cluster_id").select(
        "cluster_id",
        "nav_date",
        F.when(base == 0, F.col("level")).otherwise(F.try_divide(F.col("level"), base) * 100.0).alias("close"),
        F.col("covered"),
        F.col("anchor.nav_date").alias("anchor_date"),
        F.when(base != 0, base).alias("anchor_value"),
    )


def composite_changes(composite: DataFrame) -> DataFrame:
    """Period change of every cluster's composite; one-date composites are left out."""
    point = F.struct("nav_date", "close")
    ends = composite.groupBy("cluster_id").agg(
        F.min(point).alias("a"),
        F.max(point).alias("z"),
        F.count(F.lit(1)).alias("dates"),
        F.first("anchor_date").alias("anchor_date"),
        F.first("anchor_value").alias("anchor_value"),
    )
    start = F.when(F.col("anchor_value").isNotNull(), 100.0).otherwise(F.col("a.close"))
    return ends.filter("dates >= 2").select(
        "cluster_id",
        F.col("anchor_date").alias("start_date"),
        F.col("z.nav_date").alias("end_date"),
        start.alias("start_value"),
        F.col("z.close").alias("end_value"),
        (F.try_divide(F.col("z.close"), start) - 1.0).alias("change_pct"),
    )


def rebased_overlay(quotes: DataFrame) -> DataFrame:
    """Each symbol as percent of its first close, on the union of all dates; gaps stay NULL.

    ``quotes`` holds the few charted symbols, so dates x symbols is bounded by the chart. A
    zero or missing first close counts as 1.
    """
    rows = quotes.select("symbol_code", "quote_date", F.col("close_price").cast("double").alias("close"))
    base = (
        rows.filter(F.col("close").isNotNull())
        .groupBy("symbol_code")
        .agg(F.min(F.struct("quote_date", "close")).getField("close").alias("base"))
    )
    # The calendar bounds this array: one entry per distinct date.
    days = rows.agg(F.sort_array(F.collect_set("quote_date"))).scalar()
    grid = base.withColumn("quote_date", F.explode(days))
    base_or_one = F.when(F.col("base") == 0, 1.0).otherwise(F.col("base"))
    return grid.join(rows, ["symbol_code", "quote_date"], "left").select(
        "symbol_code", "quote_date", F.round(F.col("close") / base_or_one * 100.0, 2).alias("rebased")
    )


def distance_histogram(
    rows: DataFrame, value: str, bins: int = 10, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Equal-width bins of the non-null values; the last bin is closed on the right.

    When all values are equal there is one bin named after the value.
    """
    known = rows.filter(F.col(value).isNotNull())
    span = known.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    flat = F.col("hi") == F.col("lo")
    binned = attach(known, span, keys, "inner") if keys else known.withColumns(
        {"lo": known.agg(F.min(value)).scalar(), "hi": known.agg(F.max(value)).scalar()}
    )
    index = F.when(flat, 0).otherwise(
        F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), step)), F.lit(bins - 1))
    )
    counts = binned.groupBy(*keys, index.cast("int").alias("bin_index")).agg(
        F.count(F.lit(1)).alias("count")
    )
    slots = F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))
    i = F.col("bin_index")
    name = F.when(flat, F.format_string("%.3f", "lo")).otherwise(
        F.format_string("%.3f-%.3f", F.col("lo") + i * step, F.col("lo") + (i + 1) * step)
    )
    return (
        span.withColumn("bin_index", F.explode(slots))
        .join(counts, [*keys, "bin_index"], "left")
        .select(*keys, "bin_index", name.alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))
    )


def rank_in_cluster(rows: DataFrame, value: str, out: str = "rank_in_cluster") -> DataFrame:
    """Position by ``value`` descending inside each cluster, ties by product id."""
    return ranked(rows, ["cluster_id"], value, ["product_id"], out=out)
