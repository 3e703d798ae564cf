"""Applying the repeatable writes to stored tables.

Every change reads and rewrites only the partitions it touches, through Spark's staged dynamic
partition overwrite; a table without partitions gets a new version folder. A failed job leaves
the old files in place, so a rerun is safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.operators.runs import without_runs
from holdscope.schemas import NATURAL_KEYS, PARTITIONS
from holdscope.session import cut_lineage
from holdscope.sources.tables import conform, drop_partition, read_table, write_table
from holdscope.sources.writes import first_per_key, replaced, rows_to_append, upserted


def touched(stored: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Stored rows in the partitions that the new rows fall into.

    The partition values of a batch (its dates) are few; as literals they prune the scan.
    """
    keys = PARTITIONS.get(table)
    if not keys:
        return stored
    found = new.select(*keys).distinct().collect()
    if len(keys) == 1:
        inside = F.col(keys[0]).isin([r[0] for r in found if r[0] is not None])
        return stored.filter(inside | F.col(keys[0]).isNull() if any(r[0] is None for r in found) else inside)
    same = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(r[k])) for k in keys]) for r in found]
    return stored.filter(reduce(lambda a, b: a | b, same, F.lit(False)))


def append_new(root: str, table: str, new: DataFrame, arrival: Sequence[str]) -> tuple[int, int]:
    """Append rows whose natural key is not stored yet; returns (inserted, skipped).

    ``arrival`` names the columns that order the batch; the first row of a key goes in.
    """
    keys = NATURAL_KEYS[table]
    new = cut_lineage(new)
    stored = touched(read_table(new.sparkSession, root, table), new, table)
    rows = cut_lineage(rows_to_append(stored, new, keys, [F.col(c).asc() for c in arrival]))
    inserted = rows.count()
    if inserted:
        write_table(rows, root, table, "append")
    return inserted, new.count() - inserted


def upsert(root: str, table: str, new: DataFrame, arrival: Sequence[str], keep: Sequence[str] = ()) -> None:
    """Insert or update rows by natural key; ``keep`` columns survive an update.

    ``arrival`` names the columns that order the batch; the last row of a key wins.
    """
    keys = NATURAL_KEYS[table]
    last = cut_lineage(conform(first_per_key(new, keys, [F.col(c).desc_nulls_last() for c in arrival]), table))
    stored = touched(read_table(new.sparkSession, root, table), last, table)
    after = upserted(stored, last, keys, [F.lit(0)], keep)
    write_table(cut_lineage(after), root, table, "overwrite")


def replace(root: str, table: str, new: DataFrame) -> None:
    """Replace all rows that share a natural key with the new rows."""
    new = cut_lineage(conform(new, table))
    stored = touched(read_table(new.sparkSession, root, table), new, table)
    write_table(cut_lineage(replaced(stored, new, NATURAL_KEYS[table])), root, table, "overwrite")


def replace_runs(root: str, table: str, new: DataFrame, gone: DataFrame, key: str) -> None:
    """Drop the given runs from a run-keyed table and add the new rows in place of their own."""
    new = cut_lineage(conform(new, table))
    stored = touched(read_table(new.sparkSession, root, table), new, table)
    gone = gone.select("id").unionByName(new.select(F.col(key).alias("id"))).distinct()
    after = without_runs(stored, gone, key).unionByName(new)
    write_table(cut_lineage(after), root, table, "overwrite")


def drop_runs(spark: SparkSession, root: str, table: str, gone: Sequence[str], inside: Column) -> None:
    """Drop the given runs from the partitions that ``inside`` selects, and partitions left empty."""
    if not gone:
        return
    keys = PARTITIONS[table]
    stored = read_table(spark, root, table).filter(inside)
    hit = stored.filter(F.col("cluster_run_id").isin(list(gone)))
    dates = [tuple(r) for r in hit.select(*keys).distinct().collect()]
    if not dates:
        return
    rest = cut_lineage(stored.filter(~F.col("cluster_run_id").isin(list(gone))))
    left = {tuple(r) for r in rest.select(*keys).distinct().collect()}
    if left:
        write_table(rest, root, table, "overwrite")
    for values in dates:
        if values not in left:
            drop_partition(spark, root, table, dict(zip(keys, values, strict=True)))
