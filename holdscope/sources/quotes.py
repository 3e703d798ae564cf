"""Quote feeds landed as text: kline rows and live quote lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.parsing import to_decimal, to_int
from holdscope.functions.text import kline_prefix, market_currency, market_region, symbol_code

PRICES = ("open_price", "high_price", "low_price", "close_price", "prev_close", "change_amount", "change_pct")


def symbol_table(spark: SparkSession) -> DataFrame:
    """The fixed table of followed market symbols."""
    return spark.createDataFrame(list(C.MARKET_SYMBOLS), C.MARKET_SYMBOL_SCHEMA)


def parse_klines(rows: DataFrame, line: str = "line") -> DataFrame:
    """Kline text to typed prices next to the other columns; a bad date drops the row.

    Fields after the end of a short line are NULL.
    """
    # The split is a column of its own, so that it runs once per row and not once per field.
    split = rows.withColumn("_p", F.split(F.col(line), ","))
    field = {name: F.get(F.col("_p"), F.lit(i)) for i, name in enumerate(C.KLINE_FIELDS)}
    close, change = to_decimal(field["close"]), to_decimal(field["change_amount"])
    # The volume is converted without comma stripping.
    volume = F.trim(field["volume"]).try_cast("decimal(38,6)")
    return split.select(
        *[c for c in rows.columns if c != line],
        F.try_to_timestamp(field["date"], F.lit("yyyy-MM-dd")).cast("date").alias("quote_date"),
        to_decimal(field["open"]).alias("open_price"),
        to_decimal(field["high"]).alias("high_price"),
        to_decimal(field["low"]).alias("low_price"),
        close.alias("close_price"),
        (close - change).alias("prev_close"),
        change.alias("change_amount"),
        to_decimal(field["change_pct"]).alias("change_pct"),
        F.when(volume >= 0, F.floor(volume)).otherwise(F.ceil(volume)).cast("bigint").alias("volume"),
        to_decimal(field["amount"]).alias("amount"),
    ).filter(F.col("quote_date").isNotNull())


def in_collect_window(quotes: DataFrame, today: Column, target: Column | None = None, days: int = 60) -> DataFrame:
    """Rows of the target date, or of the look-back window that repairs missed days."""
    if target is not None:
        return quotes.filter(F.col("quote_date") == target)
    return quotes.filter(F.col("quote_date").between(F.date_sub(today, days), today))


def parse_quote_lines(rows: DataFrame, today: Column, line: str = "line") -> DataFrame:
    """Live quote lines in four layouts to typed prices.

    The layout follows the symbol prefix in the line: ``gb_`` (US), ``rt_hk``, ``hf_``
    (commodities), anything else A-share. Lines with too few fields, an empty body or, except
    for US lines, no date field are dropped. A missing change is derived from the previous
    close; a US line without a readable date counts as ``today``.
    """
    body = F.nullif(F.regexp_extract(F.col(line), '"([^"]*)"', 1), F.lit(""))
    symbol = F.regexp_extract(F.trim(F.col(line)), r"^var\s+hq_str_(\w+)\s*=", 1)
    named = rows.withColumn("_body", body).withColumn("live_symbol", symbol)
    base = named.withColumn("_p", F.split("_body", ",")).withColumn(
        "_layout",
        F.when(F.col("live_symbol").startswith("gb_"), "us")
        .when(F.col("live_symbol").startswith("rt_hk"), "hk")
        .when(F.col("live_symbol").startswith("hf_"), "commodity")
        .otherwise("a"),
    )
    layout, p = F.col("_layout"), F.col("_p")

    def at(i: int) -> Column:
        return F.get(p, F.lit(i))

    def by_layout(**index: int) -> Column:
        out = None
        for name, i in index.items():
            value = to_decimal(at(i))
            out = F.when(layout == name, value) if out is None else out.when(layout == name, value)
        return out

    dates = F.filter(p, lambda x: F.trim(x).rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$"))
    token = F.replace(F.trim(F.get(dates, F.lit(0))), F.lit("/"), F.lit("-"))
    us_day = F.regexp_extract(F.trim(at(3)), r"^(\d{4}-\d{2}-\d{2})\s+\d{2}:\d{2}:\d{2}", 1)
    day_text = F.when(layout == "us", us_day).otherwise(token)
    day = F.coalesce(F.try_to_timestamp(day_text, F.lit("yyyy-MM-dd")).cast("date"), today)

    need = F.when(layout == "us", 26).when(layout == "hk", 7).when(layout == "commodity", 14).otherwise(10)
    usable = (F.col("live_symbol") != "") & (F.size(p) >= need) & ((layout == "us") | token.isNotNull())

    close = by_layout(us=1, hk=6, commodity=0, a=3)
    prev = by_layout(us=25, hk=3, commodity=7, a=2)
    hundred = F.lit(100).cast("decimal(10,0)")
    us_change, raw_pct = by_layout(us=4), by_layout(us=2, commodity=1)
    priced = base.filter(usable).select(
        *[c for c in rows.columns if c != line],
        "live_symbol",
        day.alias("quote_date"),
        by_layout(us=5, hk=2, commodity=8, a=1).alias("open_price"),
        by_layout(us=6, hk=4, commodity=4, a=4).alias("high_price"),
        by_layout(us=7, hk=5, commodity=5, a=5).alias("low_price"),
        close.alias("close_price"),
        prev.alias("prev_close"),
        us_change.alias("_change"),
        raw_pct.alias("_pct"),
        (layout == "us").alias("_us"),
        F.when(layout == "us", to_int(at(10))).when(layout == "a", to_int(at(8))).alias("volume"),
        F.when(layout == "a", to_decimal(at(9))).alias("amount"),
    )
    c, v, pct = F.col("close_price"), F.col("prev_close"), F.col("_pct")
    from_pct = F.when(v != 0, v * pct / hundred)
    change = F.when(F.col("_us"), F.coalesce(F.col("_change"), from_pct)).otherwise(c - v)
    rated = priced.withColumn("change_amount", change.cast("decimal(18,4)"))
    # Divided last, so that no digits are lost before the percent scale.
    derived = F.try_divide(F.col("change_amount") * hundred, v)
    return rated.withColumn("change_pct", F.coalesce(pct, derived.cast("decimal(18,4)"))).drop(
        "_change", "_pct", "_us"
    )


def with_symbol(quotes: DataFrame, symbols: DataFrame, on: str) -> DataFrame:
    """Quotes with the metadata of their followed symbol; other symbols drop out."""
    return quotes.join(symbols, on, "inner")


def stock_quotes(klines: DataFrame) -> DataFrame:
    """Parsed klines of stocks with the metadata that follows from code and market."""
    code, market = F.col("asset_code"), F.col("market")
    return klines.withColumns(
        {
            "symbol_code": symbol_code(code, market),
            "market_region": market_region(market),
            "asset_class": F.lit("stock"),
            "volume_unit": F.lit("share"),
            "currency": market_currency(market),
            "source_code": F.concat_ws(".", kline_prefix(market), code),
        }
    ).filter(kline_prefix(market).isNotNull())


def primary_or_fallback(primary: DataFrame, fallback: DataFrame, key: str = "symbol_code") -> DataFrame:
    """All primary rows, plus fallback rows of symbols the primary source did not return."""
    have = primary.select(key).distinct()
    return primary.unionByName(fallback.join(have, key, "left_anti"))


def symbol_status(expected: DataFrame, quotes: DataFrame) -> DataFrame:
    """Source, status and date range of every expected symbol."""
    seen = quotes.groupBy("symbol_code").agg(
        F.min("data_source").alias("source"),
        F.min("quote_date").alias("quote_date_min"),
        F.max("quote_date").alias("quote_date_max"),
    )
    return expected.select("symbol_code").join(seen, "symbol_code", "left").withColumn(
        "status", F.when(F.col("quote_date_max").isNotNull(), "success").otherwise("failed")
    )
