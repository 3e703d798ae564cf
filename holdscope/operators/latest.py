"""Latest-per-key reads over snapshot tables and time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators.skew import top_rows

PRODUCT = ("institution_code", "product_code")


def latest_snapshot(
    products: DataFrame,
    keys: Sequence[str] = PRODUCT,
    date: str = "collect_date",
    tiebreak: str = "product_id",
) -> DataFrame:
    """The newest snapshot row of each product; same-day rows fall to the highest id.

    The holdings cross-section keys by ``product_code`` alone, everything else by
    institution and code.
    """
    return top_rows(products, keys, [F.col(date).desc_nulls_last(), F.col(tiebreak).desc()])


def latest_value(series: DataFrame, key: str, date: str, columns: Sequence[str], tiebreak: str) -> DataFrame:
    """Latest row of a series per key, such as the last NAV of each product."""
    return top_rows(series, [key], [F.col(date).desc(), F.col(tiebreak).desc()]).select(
        key, date, *columns
    )


def latest_by_max_date(rows: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All rows dated at their key's last date (ties are kept).

    ``rank() = 1`` lets every map task drop a key's older rows before the shuffle. What is
    left of a key is the rows of one date, which the natural keys of the tables bound.
    """
    dated = rows.filter(F.col(date).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return dated.withColumn("_rank", F.rank().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def latest_quotes(
    quotes: DataFrame,
    region: str | None = None,
    asset_classes: Sequence[str] | None = None,
    quote_date: Column | None = None,
) -> DataFrame:
    """Quotes of one date, or every symbol's last quote when no date is given.

    The last date is chosen before the region and class filters apply. An empty class list
    shows all classes.
    """
    rows = quotes.filter(F.col("quote_date") == quote_date) if quote_date is not None else (
        latest_by_max_date(quotes, ["symbol_code"], "quote_date")
    )
    if region:
        rows = rows.filter(F.col("market_region") == region)
    if asset_classes:
        rows = rows.filter(F.col("asset_class").isin(*asset_classes))
    return rows.orderBy("market_region", "symbol_code")


def nav_history(nav: DataFrame, products: DataFrame, limit: int = 50) -> DataFrame:
    """NAV history of every logical product over all its snapshots.

    One value per date (the newest row wins), the newest ``limit`` dates of each product, in
    ascending date order.
    """
    siblings = products.select(*PRODUCT, "product_id")
    rows = nav.join(siblings, "product_id")
    one_per_date = top_rows(rows, [*PRODUCT, "nav_date"], [F.col("id").desc()])
    recent = top_rows(one_per_date, PRODUCT, [F.col("nav_date").desc()], limit)
    return recent.orderBy(*PRODUCT, "nav_date")


def nav_date_count(nav: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct NAV dates of each logical product."""
    siblings = products.select(*PRODUCT, "product_id")
    return nav.join(siblings, "product_id").groupBy(*PRODUCT).agg(
        F.countDistinct("nav_date").alias("nav_dates")
    )


def report_history(reports: DataFrame, products: DataFrame, summaries: DataFrame) -> DataFrame:
    """Reports of every logical product, one per report date, the newest snapshot's wins."""
    snapshots = products.select(*PRODUCT, "product_id", "collect_date")
    rows = reports.join(snapshots, "product_id")
    one = top_rows(
        rows,
        [*PRODUCT, "report_date"],
        [F.col("collect_date").desc(), F.col("report_id").desc()],
    )
    metrics = summaries.select("report_id", "holding_count", "top10_weight")
    return one.join(metrics, "report_id", "left")


def latest_report(reports: DataFrame, products: DataFrame) -> DataFrame:
    """The most recent report of every logical product."""
    snapshots = products.select(*PRODUCT, "product_id", "collect_date")
    return top_rows(
        reports.join(snapshots, "product_id"),
        PRODUCT,
        [F.col("report_date").desc(), F.col("collect_date").desc(), F.col("report_id").desc()],
    )


def fetch_work_list(
    products: DataFrame, reports: DataFrame, institution_type: str | None = None, skip_existing: bool = True
) -> DataFrame:
    """Latest snapshots whose own newest report is missing or older than the newest of all.

    Reports are matched by snapshot id, so a new snapshot without reports stays on the list.
    """
    if institution_type is not None:
        products = products.filter(F.col("institution_type") == institution_type)
    last = latest_by_max_date(products, PRODUCT, "collect_date")
    if skip_existing:
        own = reports.groupBy("product_id").agg(F.max("report_date").alias("own_report_date"))
        newest = reports.agg(F.max("report_date")).scalar()
        last = last.join(own, "product_id", "left").filter(
            F.col("own_report_date").isNull() | (F.col("own_report_date") < newest)
        )
    return last


def share_of(value: str, keys: Sequence[str]) -> Column:
    """Value over its group's total; a zero total leaves the value as is.

    For groups that are bounded after aggregation (industries of a product, dates of a symbol).
    """
    total = F.sum(value).over(Window.partitionBy(*keys))
    return F.when(total == 0, F.col(value)).otherwise(F.col(value) / total)
