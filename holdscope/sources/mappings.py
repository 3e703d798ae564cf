"""Mapping files: industry by ``code|market`` and index constituent weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.text import contains_any, lookup


def read_industry_mapping(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON objects ``{"code|market": industry}`` to rows; a key without a market is UNKNOWN."""
    entries = rows.select(F.explode(F.from_json(F.col(payload), "map<string,string>")).alias("key", "industry_name"))
    parts = F.split("key", r"\|", 2)
    return entries.select(
        F.get(parts, F.lit(0)).alias("asset_code"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("UNKNOWN")).alias("market"),
        "industry_name",
    )


def industry_mapping_lines(industries: DataFrame) -> DataFrame:
    """Mapping rows as one-entry JSON objects, ready for ``write.text``."""
    key = F.concat_ws("|", "asset_code", "market")
    return industries.select(F.to_json(F.create_map(key, F.col("industry_name"))).alias("value"))


def exchange_market(exchange: Column) -> Column:
    """Market of an exchange name: the full name first, then a place name inside it."""
    out = F.lit("UNKNOWN")
    for word, market in reversed(C.EXCHANGE_HINTS):
        out = F.when(contains_any(exchange, (word,)), market).otherwise(out)
    return F.coalesce(lookup(exchange, C.EXCHANGE_MARKETS), out)


def zero_filled(c: Column, width: int = 6) -> Column:
    """Trimmed code, zeros in front up to the width; longer codes stay whole."""
    t = F.trim(c.cast("string"))
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def index_weight_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Constituent weights from a ten-column file read by position.

    ``columns`` names the file's columns in order. Bad dates and weights become NULL; percent
    becomes a fraction.
    """
    if len(columns) < 10:
        raise ValueError("an index weight file has ten columns")
    date, index, index_name, code, name, exchange, weight = (F.col(columns[i]) for i in (0, 1, 2, 4, 5, 7, 9))
    index_code = zero_filled(index)
    return rows.select(
        index_code.alias("index_code"),
        F.coalesce(lookup(index_code, C.SUPPORTED_INDEXES), index_name).alias("index_name"),
        zero_filled(code).alias("constituent_code"),
        name.alias("constituent_name"),
        exchange_market(exchange).alias("market"),
        (weight.cast("string").try_cast("double") / 100.0).alias("weight"),
        F.try_to_timestamp(date.cast("string"), F.lit("yyyyMMdd")).cast("date").alias("effective_date"),
    )
