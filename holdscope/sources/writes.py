"""Repeatable writes, as functions of the stored table and the new rows.

Each returns the rows to store (or the new state of the table); nothing is written here, so
the same functions serve a batch job and a streaming ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.operators.skew import top_rows


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def first_per_key(rows: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """The first row of each key in arrival order. A key with an unset part never conflicts."""
    firsts = top_rows(rows.filter(_complete(keys)), keys, arrival)
    return firsts.unionByName(rows.filter(~_complete(keys)))


def rows_to_append(target: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """New rows whose key is not stored yet; of equal keys the first arrival is taken.

    ``target`` should be cut to the partitions the batch touches, so that a small batch does
    not read the whole table.
    """
    return first_per_key(new, keys, arrival).join(target.select(*keys), [*keys], "left_anti")


def append_counts(target: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """How many rows of a batch go in and how many are skipped."""
    inserted = rows_to_append(target, new, keys, arrival).agg(F.count(F.lit(1))).scalar()
    return new.agg(F.count(F.lit(1)).alias("_n")).select(
        inserted.alias("inserted"), (F.col("_n") - inserted).alias("skipped")
    )


def security_rows(holdings: DataFrame) -> DataFrame:
    """Reference rows for the securities in a holdings batch; rows without a code have none."""
    return holdings.filter(F.col("asset_code").isNotNull() & (F.col("asset_code") != "")).select(
        "asset_code",
        F.coalesce(F.nullif("market", F.lit("")), F.lit("UNKNOWN")).alias("market"),
        "asset_name",
        "asset_type",
        "industry_name",
    )


def upserted(
    target: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[Column], keep: Sequence[str] = ()
) -> DataFrame:
    """The table after new rows replaced stored rows of the same key.

    Of equal keys in the batch the last arrival wins. Columns in ``keep`` (ids, creation
    times) keep the stored value when there is one.
    """
    last = top_rows(new, keys, arrival)
    if keep:
        old = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
        last = last.join(old, [*keys], "left")
        last = last.withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep})
        last = last.drop(*[f"_old_{c}" for c in keep])
    return target.join(last.select(*keys), [*keys], "left_anti").unionByName(last.select(*target.columns))


def replaced(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after all stored rows of the new rows' keys were replaced; NULL keys match."""
    gone = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return target.join(gone, same, "left_anti").unionByName(new.select(*target.columns))


def stale_condition(now: Column, stale_minutes: int = 30, job_name: str | None = None) -> Column:
    """Jobs that still claim to run although they started too long ago."""
    old = F.col("start_time") < now - F.make_interval(mins=F.lit(stale_minutes))
    stale = (F.col("status") == "running") & old
    return stale if job_name is None else stale & (F.col("job_name") == job_name)


def close_stale(logs: DataFrame, now: Column, stale_minutes: int = 30, job_name: str | None = None) -> DataFrame:
    """The job log with stale jobs closed as failed."""
    stale = F.coalesce(stale_condition(now, stale_minutes, job_name), F.lit(False))
    return logs.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "end_time": F.when(stale, now).otherwise(F.col("end_time")),
            "error_message": F.when(stale, C.STALE_MESSAGE).otherwise(F.col("error_message")),
        }
    )


def stale_count(logs: DataFrame, now: Column, stale_minutes: int = 30, job_name: str | None = None) -> DataFrame:
    """Number of jobs ``close_stale`` closes."""
    return logs.filter(stale_condition(now, stale_minutes, job_name)).agg(F.count(F.lit(1)).alias("closed"))
