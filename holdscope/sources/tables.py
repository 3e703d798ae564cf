"""Reading and writing the declared tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.schemas import PARTITIONS, schema_of


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table without partitions, oldest first."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [n for n in names if n.startswith("version=") and fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.partition("=")[2]) for n in done)


def _location(spark: SparkSession, root: str, table: str) -> str:
    path = f"{root}/{table}"
    if PARTITIONS.get(table):
        return path
    return f"{path}/version={(_versions(spark, path) or [0])[-1]}"


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A stored table with its declared schema; nothing is inferred."""
    return spark.read.schema(schema_of(table)).parquet(_location(spark, root, table))


def create_table(spark: SparkSession, root: str, table: str) -> None:
    """An empty table in the declared layout."""
    write_table(spark.createDataFrame([], schema_of(table)), root, table, "ignore")


def write_table(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    """Write rows in the table's partition layout.

    Rows are gathered by partition value first, so a date becomes few files; a big date still
    spreads over several tasks because AQE splits it. Overwriting replaces the dates of the new
    rows alone. A table without partitions is overwritten by a new version, which readers see
    once it is complete; the version before it stays for those that still read it.
    """
    spark = df.sparkSession
    keys = PARTITIONS.get(table, [])
    out = conform(df, table)
    if keys:
        writer = out.hint("rebalance", *keys).write.mode(mode)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*keys).parquet(f"{root}/{table}")
        return
    path = f"{root}/{table}"
    if mode != "overwrite":
        out.write.mode(mode).parquet(_location(spark, root, table))
        return
    versions = _versions(spark, path)
    now = versions[-1] + 1 if versions else 0
    out.write.mode("overwrite").parquet(f"{path}/version={now}")
    for old in versions[:-1]:
        fs, at = _folder(spark, f"{path}/version={old}")
        fs.delete(at, True)


def drop_partition(spark: SparkSession, root: str, table: str, values: dict[str, Any]) -> None:
    """Remove one partition with all its files."""
    name = "/".join(f"{k}={v}" for k, v in values.items())
    fs, at = _folder(spark, f"{root}/{table}/{name}")
    fs.delete(at, True)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in the declared columns and types; columns that are missing become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema_of(table).fields
        ]
    )


def run_sql(spark: SparkSession, query: str, params: dict[str, Any], **tables: DataFrame) -> DataFrame:
    """A SQL read with named parameters over the given tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=params)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON object with ISO dates; unset fields are kept as null."""
    return df.select(
        F.to_json(
            F.struct("*"), {"dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}
        ).alias(column)
    )
