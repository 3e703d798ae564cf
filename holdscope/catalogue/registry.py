"""The query catalogue: a name, a Spark function of (spark, folder), and oracle SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of a ``Domain`` under its own name."""

    def register(fn: Callable[[Domain], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round computed doubles, since sums differ in order between engines."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})
