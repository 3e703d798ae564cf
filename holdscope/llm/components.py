"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import materialise


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link; the root is the smallest node reachable.

    ``links`` has bigint columns ``u`` and ``v``. Each round is two aggregations and two joins, whose
    hot nodes are combined before the shuffle or split by adaptive execution; the number of rounds
    grows with the logarithm of the longest chain. An empty table gives an empty table.
    """
    links = materialise(links.select("u", "v").filter("u <> v"), "links")
    before = None
    while True:
        links = materialise(_small_star(_large_star(links)), "links")
        now = _digest(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
