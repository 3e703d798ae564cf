"""Industry return series and their correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.functions.text import strip, strip_exchange
from holdscope.operators.skew import top_rows
from holdscope.session import cut_lineage


def with_industry(quotes: DataFrame, securities: DataFrame) -> DataFrame:
    """Quotes with the industry of their bare code; the last security row of a code wins."""
    known = securities.filter(F.col("industry_name").isNotNull() & (strip(F.col("industry_name")) != ""))
    by_code = top_rows(known, ["asset_code"], [F.col("market").desc_nulls_last()]).select(
        F.col("asset_code").alias("_code"), F.col("industry_name").alias("industry")
    )
    return quotes.withColumn("_code", strip_exchange(F.col("symbol_code"))).join(by_code, "_code").drop("_code")


def symbol_industry(rows: DataFrame) -> DataFrame:
    """Most frequent industry of each symbol; a tie takes the smallest name."""
    counts = rows.groupBy("symbol_code", "industry").agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, ["symbol_code"], [F.col("n").desc(), F.col("industry").asc()]).drop("n")


def daily_changes(rows: DataFrame) -> DataFrame:
    """Change of each symbol against its previous observed close, next to the other columns.

    A day without a close counts as no change, so only observed days need a row here;
    ``industry_returns`` puts the zero days back through its denominators. One symbol has at
    most one row per date, so the ordered window is bounded by the calendar.
    """
    w = Window.partitionBy("symbol_code").orderBy("quote_date")
    close = F.col("close_price").cast("double")
    return rows.withColumn("prev", F.lag(close).over(w)).withColumn(
        "change", F.try_divide(close, F.col("prev")) - 1.0
    )


def industry_returns(rows: DataFrame, min_stocks: int = 8, min_days: int = 30) -> DataFrame:
    """Equal-weight daily return of each industry.

    ``rows`` has one close per (symbol, date) and one industry per symbol. A symbol takes part
    from the day after its first close; on days without a close its return is zero. Industries
    need ``min_stocks`` symbols and ``min_days`` returns.

    The zero-filled date x symbol grid is never built: the sum needs only observed changes,
    and the denominator is the running count of symbols that have started. The closes are read
    once; all later steps work on the (industry, date) table.
    """
    changes = daily_changes(rows.select("symbol_code", "quote_date", "close_price", "industry"))
    per_day = cut_lineage(
        changes.groupBy("industry", "quote_date").agg(
            F.sum("change").alias("total"),
            F.count_if(F.col("prev").isNull()).alias("started"),
        )
    )
    big = per_day.groupBy("industry").agg(F.sum("started").alias("n")).filter(F.col("n") >= min_stocks)
    # The calendar bounds this array, and the industry list bounds the grid.
    days = per_day.select("quote_date").distinct().agg(F.collect_list("quote_date")).scalar()
    grid = big.select("industry", F.explode(days).alias("quote_date"))
    before = Window.partitionBy("industry").orderBy("quote_date").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(per_day, ["industry", "quote_date"], "left").withColumn(
        "active", F.sum(F.coalesce("started", F.lit(0))).over(before)
    )
    per_industry = Window.partitionBy("industry")
    return (
        filled.filter(F.col("active") > 0)
        .withColumn("n", F.count(F.lit(1)).over(per_industry))
        .filter(F.col("n") >= min_days)
        .select(
            "industry",
            "quote_date",
            (F.coalesce("total", F.lit(0.0)) / F.col("active")).alias("industry_return"),
        )
    )


def cumulative_index(returns: DataFrame) -> DataFrame:
    """Compounded return of each industry, 100 on the first date of the whole report.

    An industry without a return on that date has no base and stays NULL. Each industry has
    one row per trading day, so its ordered window is bounded by the calendar.
    """
    w = Window.partitionBy("industry").orderBy("quote_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    first_day = returns.agg(F.min("quote_date")).scalar()
    rows = returns.withColumn("product", F.product(1.0 + F.col("industry_return")).over(w))
    base = F.max(F.when(F.col("quote_date") == first_day, F.col("product"))).over(Window.partitionBy("industry"))
    return rows.select(
        "industry", "quote_date", F.round(F.try_divide(F.col("product"), base) * 100.0, 3).alias("level")
    )


def correlation(returns: DataFrame, min_periods: int = 20) -> DataFrame:
    """Pearson correlation of every industry pair ``a <= b`` over their shared dates.

    The pair table is the result itself and is bounded by the industry classification: the
    input is already one row per (industry, date). Sums per pair are combined on the map side.
    Pairs with too few dates or a constant series are NULL.
    """
    # Centring first keeps the one-pass sums accurate. Both the series and the pair table are
    # small, and each is read several times.
    mean = F.avg("industry_return").over(Window.partitionBy("industry"))
    centred = cut_lineage(
        returns.withColumn("r", F.col("industry_return") - mean).select("industry", "quote_date", "r")
    )
    a = centred.select(F.col("industry").alias("industry_a"), "quote_date", F.col("r").alias("x"))
    b = centred.select(F.col("industry").alias("industry_b"), "quote_date", F.col("r").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = (
        a.join(b, "quote_date")
        .filter(F.col("industry_a") <= F.col("industry_b"))
        .groupBy("industry_a", "industry_b")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("sx"),
            F.sum(y).alias("sy"),
            F.sum(x * x).alias("sxx"),
            F.sum(y * y).alias("syy"),
            F.sum(x * y).alias("sxy"),
        )
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    va = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vb = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((n >= min_periods) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    return cut_lineage(sums.select("industry_a", "industry_b", "n", r.alias("corr")))


def _both_sides(corr: DataFrame) -> DataFrame:
    """The full square matrix from its upper triangle."""
    lower = corr.filter("industry_a < industry_b").select(
        F.col("industry_b").alias("industry_a"), F.col("industry_a").alias("industry_b"), "corr"
    )
    return corr.select("industry_a", "industry_b", "corr").unionByName(lower)


def correlation_summary(corr: DataFrame) -> DataFrame:
    """Industry count, mean absolute correlation with the diagonal, extremes without it."""
    off = F.col("industry_a") != F.col("industry_b")
    per_column = _both_sides(corr).groupBy("industry_b").agg(F.avg(F.abs("corr")).alias("m"))
    mean = per_column.agg(F.avg("m")).scalar()
    return corr.agg(
        F.countDistinct("industry_a").alias("n_industries"),
        F.max(F.when(off, F.col("corr"))).alias("max_corr"),
        F.min(F.when(off, F.col("corr"))).alias("min_corr"),
    ).withColumn("mean_abs_corr", mean)


def top_pairs(corr: DataFrame, n: int = 10) -> DataFrame:
    """Strongest positive, negative and absolute pairs, ``n`` of each."""
    pairs = corr.filter((F.col("industry_a") < F.col("industry_b")) & F.col("corr").isNotNull())
    ids = [F.col("industry_a").asc(), F.col("industry_b").asc()]
    sides = (
        ("positive", pairs.filter("corr > 0"), F.col("corr").desc()),
        ("negative", pairs.filter("corr < 0"), F.col("corr").asc()),
        ("strongest", pairs, F.abs("corr").desc()),
    )
    out = None
    for name, rows, order in sides:
        part = rows.orderBy(order, *ids).limit(n).select(
            F.lit(name).alias("side"), "industry_a", "industry_b", "corr"
        )
        out = part if out is None else out.unionByName(part)
    return out


def one_against_rest(corr: DataFrame, industry: str, n: int = 10) -> DataFrame:
    """Correlation of one industry with all others: top positive, top negative, full list."""
    rest = (
        _both_sides(corr)
        .filter((F.col("industry_a") == industry) & (F.col("industry_b") != industry))
        .filter(F.col("corr").isNotNull())
        .select(F.col("industry_b").alias("industry"), "corr")
    )
    name = F.col("industry").asc()
    positive = rest.filter("corr > 0").orderBy(F.col("corr").desc(), name).limit(n)
    negative = rest.filter("corr < 0").orderBy(F.col("corr").asc(), name).limit(n)
    return (
        positive.withColumn("side", F.lit("positive"))
        .unionByName(negative.withColumn("side", F.lit("negative")))
        .unionByName(rest.withColumn("side", F.lit("full")))
    )
