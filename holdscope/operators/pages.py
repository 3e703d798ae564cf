"""Pages of a stored order: any page, however deep, is read from the ranges that hold it.

Rows are written once in ranges of their order, with the number of rows of each range. A page's rows are then found by
counting, and the files of other ranges are not opened. ``browse.page`` serves results that are not stored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdscope.functions.parsing import page_number, page_size

#: Rows of a range, about, and ranges at most; a range of a larger table has more rows.
RANGE_ROWS, MAX_RANGES = 100_000, 512


def store_order(rows: DataFrame, order: Sequence[Column], path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write ``rows`` in ranges of a total order below ``path``, and the rows of each range beside them.

    The order is that of all pages read later. The ranges are bounded in number, since each is a task and a folder that the
    driver hears of. Columns named ``_range`` and ``_place`` are added. A rerun replaces the files.
    """
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, min(MAX_RANGES, -(-n // range_rows))), *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    spark, schema = rows.sparkSession, placed.schema
    stored = spark.read.schema(schema).parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    # A range before all others, without rows, is there even for an empty order; it tells the schema.
    none = spark.range(1).select(F.lit(-1).alias("_range"), F.lit(0).cast("bigint").alias("n"))
    about = counts.unionByName(none).withColumn("schema", F.when(F.col("_range") == -1, F.lit(schema.json())))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")


def ranges_of(spark: SparkSession, path: str, begin: int, end: int) -> list[tuple[int, int]]:
    """The ranges that hold the places from ``begin`` to ``end``, each with the number of rows before it."""
    out, before = [], 0
    for r in spark.read.parquet(f"{path}/ranges").orderBy("_range").toLocalIterator():
        if before < end and before + r["n"] > begin:
            out.append((r["_range"], before))
        before += r["n"]
    return out


def read_page(spark: SparkSession, path: str, number: int | None = 1, size: int | None = 25) -> DataFrame:
    """One page of a stored order, with ``place`` from zero; an empty one behind the end."""
    size = page_size(size)
    begin = (page_number(number) - 1) * size
    held = ranges_of(spark, path, begin, begin + size)
    told = spark.read.parquet(f"{path}/ranges").filter("_range = -1").first()["schema"]
    rows = spark.read.schema(StructType.fromJson(json.loads(told))).parquet(f"{path}/rows")
    rows = rows.filter(F.col("_range").isin([r for r, _ in held]))
    before = F.coalesce(*[F.when(F.col("_range") == r, F.lit(n)) for r, n in held], F.lit(0))
    rows = rows.withColumn("place", before + F.col("_place")).drop("_range", "_place")
    return rows.filter(F.col("place").between(begin, begin + size - 1)).orderBy("place")


def last_page(spark: SparkSession, path: str, size: int | None = 25) -> int:
    """Number of the last page; an empty result has one."""
    n = spark.read.parquet(f"{path}/ranges").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return max(1, -(-n // page_size(size)))
