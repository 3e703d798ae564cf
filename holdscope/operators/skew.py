"""Shapes that keep one hot key from landing in one task.

Three cases cover the library:

* top-n per key is ``row_number() <= n``; Spark prunes each map task to n rows per key
  before the shuffle (``WindowGroupLimit``), so a hot key ships n rows per task;
* attaching a per-key value to many rows is a plain join with the many rows on the left:
  adaptive execution splits a hot key's rows over tasks, and no side is repeated for keys
  that are not hot;
* a full ranking inside a key is done in ranges of the whole order, ties included, so no
  task sorts the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.session import cut_lineage

# A side is broadcast on our own account only when its counted rows stay under this size.
BROADCAST_BYTES = 32 << 20
# Rows that one task sorts or groups at a time, about; a larger table gets more tasks.
TASK_ROWS = 500_000


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given (total) order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def attach(facts: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many ``facts`` rows to the one ``per_key`` row of their key.

    Spark broadcasts ``per_key`` when its measured size allows; beyond that, the sort-merge join
    splits the facts of a hot key and reads its one row in each part.
    """
    return facts.join(per_key, [*on], how)


def fits_broadcast(rows: int, bytes_per_row: int) -> bool:
    """Whether a counted side is small enough to send to every executor."""
    return rows * bytes_per_row <= BROADCAST_BYTES


def beside(per_key: DataFrame, bytes_per_row: int) -> DataFrame:
    """A per-key side, broadcast if its counted rows allow: the many rows are then not shuffled for it."""
    return F.broadcast(per_key) if fits_broadcast(per_key.count(), bytes_per_row) else per_key


def width_of(spark: SparkSession, rows: int) -> int:
    """Tasks for so many counted rows: every core has one, and none has many more than ``TASK_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tiebreak: Sequence[str],
    out: str = "rank",
    descending: bool = True,
    weight: Column | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Exact position of each row inside its key, without sorting a hot key in one task.

    All rows are cut into ranges of (keys, value, tiebreak), so that equal values and NULLs split
    like any others. Rows are ranked inside their range, and the rows of their key in the ranges
    before are added as an offset. Only a key at the edge of a range goes on in another, so there
    are at most as many offsets as ranges, and they are broadcast. ``weight`` counts a row as that many rows; the position is then
    the running total up to and including the row. NULL values come last, NULL keys are a key.

    ``df`` is read twice, to find the ranges and to deal them out, so an expensive input should be
    materialised first. ``ranges`` defaults to the session's shuffle width, or more if the counted
    rows ask for it.
    """
    spark = df.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), width_of(spark, df.count()))
    one = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order_by = [order, *[F.col(c).asc() for c in tiebreak]]
    dealt = df.withColumn("_one", one).repartitionByRange(ranges, *[F.col(k).asc() for k in keys], *order_by)
    # The range of a row is the task it came to; written down, it cannot change under a rerun.
    placed = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    key = F.struct(*[F.col(k).alias(n) for k, n in names.items()])
    edges = placed.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    edges = edges.select(F.explode(F.array("first", "last")).alias("k")).select("k.*").distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    before = Window.partitionBy(*names.values()).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.join(F.broadcast(edges), same)
        .groupBy(*names.values(), F.col("_range").alias("_at"))
        .agg(F.sum("_one").alias("_n"))
        .select(*names.values(), "_at", F.sum("_n").over(before).alias("_offset"))
        .filter("_offset > 0")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    running = F.sum("_one").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = placed.repartition(ranges, *keys, "_range").withColumn("_local", running)
    return (
        local.join(F.broadcast(offsets), same & (F.col("_range") == F.col("_at")), "left")
        .withColumn(out, F.col("_local") + F.coalesce("_offset", F.lit(0)))
        .drop("_one", "_range", "_local", "_offset", "_at", *names.values())
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None
) -> DataFrame:
    """Median of non-null values per key, read off the middle positions; equal values are counted, not ranked."""
    levels = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    levels = cut_lineage(levels)
    totals = levels.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    upto = ranked(levels, keys, value, [value], out="_upto", descending=False, weight=F.col("_c"), ranges=ranges)

    def holds(position: Column) -> Column:
        return ((position > F.col("_upto") - F.col("_c")) & (position <= F.col("_upto"))).cast("int")

    middle = holds(F.floor((F.col("_n") + 1) / 2)) + holds(F.ceil((F.col("_n") + 1) / 2))
    return (
        attach(upto, totals, keys, "inner")
        .withColumn("_middle", middle)
        .filter("_middle > 0")
        .groupBy(*keys)
        .agg((F.sum(F.col(value) * F.col("_middle")) / 2).alias("median"))
    )
