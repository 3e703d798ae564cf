"""The most similar products of every product, without forming a row per pair.

Products are laid out in blocks by their heaviest feature. A block keeps inverted lists with the largest weight of each
feature. A product first searches its own block; its n-th best score is then the threshold for the others. Two blocks meet
in one task, where the products of either search the other; a product does so only if the largest weights of the other
block could bring it above its threshold. The lists of all features of a product are added up at once. There are a few
blocks more than fill the cores, or as many as keep a block within ``BLOCK_CELLS``, so that a product is copied as often as
there are blocks and a task holds two of them. A task returns at most n rows per product and block.

Blocks meet in rounds. A round copies the products a few times only, and its copies leave the disk before the next one, so
what is on disk at a time grows with the products, not with the pairs of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators.similarity import METRIC_COLUMN, METRICS
from holdscope.operators.skew import attach, fits_broadcast, top_rows
from holdscope.session import discard, materialise, ship_package

#: Blocks of a small table, and cells that a block of a large one holds on average.
BLOCKS, BLOCK_CELLS = 8, 16 << 20
#: Cells that a round of meetings copies, about; it copies each cell twice at least.
ROUND_CELLS = 1 << 30
#: Tasks dealt for each meeting, so that few meetings share one.
SPREAD = 3
SLACK = 1e-9
#: Scores compare at this many decimals, so that the order of a sum does not decide.
DECIMALS = 9


def needed(score, size, metric: str):
    """The least sum of contributions that a product of ``size`` features needs for a score; numbers or columns."""
    return score * size if metric == "jaccard" else score


def contributions(own: np.ndarray, weights: np.ndarray, metric: str) -> np.ndarray:
    if metric == "overlap":
        return np.minimum(own, weights)
    return own * weights if metric == "cosine" else np.ones(len(weights))


@dataclass
class Cells:
    """The products of a block end to end: ``at`` and ``w`` of product ``i`` are ``begin[i]`` to ``begin[i + 1]``."""

    ids: np.ndarray
    begin: np.ndarray
    at: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Cells:
        at, w = (table.column(c).combine_chunks() for c in ("at", "w"))
        sizes = at.value_lengths().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in (at, w)]
        return cls(np.array(table.column("product_id").to_pylist()), begin, *flat)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.begin)


@dataclass
class Lists:
    """Inverted lists of a block: members and weights of feature ``names[i]`` are ``begin[i]`` to ``begin[i + 1]``."""

    ids: np.ndarray
    sizes: np.ndarray
    names: np.ndarray
    begin: np.ndarray
    members: np.ndarray
    w: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, cells: Cells) -> Lists:
        order = np.argsort(cells.at, kind="stable")
        names, first = np.unique(cells.at[order], return_index=True)
        members = np.repeat(np.arange(len(cells.ids)), cells.sizes)[order]
        w = cells.w[order]
        most = np.maximum.reduceat(w, first) if len(first) else w
        return cls(cells.ids, cells.sizes, names, np.append(first, len(order)), members, w, most)

    def search(self, asking: Cells, metric: str, n: int, floors: np.ndarray) -> list[tuple]:
        """Of each asking product the first ``n`` members with a positive score of its floor or more: (id, members, scores)."""
        if not len(self.names) or not len(asking.at):
            return []
        found = np.minimum(np.searchsorted(self.names, asking.at), len(self.names) - 1)
        here = self.names[found] == asking.at
        part = np.where(here, contributions(asking.w, self.most[found], metric), 0.0)
        bound = np.concatenate([[0.0], np.cumsum(part)])
        bound = bound[asking.begin[1:]] - bound[asking.begin[:-1]]
        maybe = bound >= needed(floors, asking.sizes, metric) - SLACK * (1 + bound)
        out = []
        for i in np.flatnonzero(maybe & (bound > 0)).tolist():
            a, b = asking.begin[i], asking.begin[i + 1]
            lists, own = found[a:b][here[a:b]], asking.w[a:b][here[a:b]]
            start, size = self.begin[lists], self.begin[lists + 1] - self.begin[lists]
            ends = np.cumsum(size)
            entries = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
            added = contributions(np.repeat(own, size), self.w[entries], metric)
            score = np.bincount(self.members[entries], added, len(self.ids))
            met = np.flatnonzero(score > 0)
            score = score[met]
            if metric == "jaccard":
                score = score / (b - a + self.sizes[met] - score)
            score = np.round(score, DECIMALS)
            keep = (score > 0) & (score >= floors[i]) & (self.ids[met] != asking.ids[i])
            met, score = met[keep], score[keep]
            if len(met) > n:  # ties with the n-th stay for the order by id
                least = np.partition(score, len(score) - n)[len(score) - n]
                met, score = met[score >= least], score[score >= least]
            first = np.lexsort((self.ids[met], -score))[:n]
            out.append((asking.ids[i], self.ids[met[first]], score[first]))
        return out


def _found(kind: pa.DataType, rows: list[tuple]) -> pa.Table:
    own, other, score = zip(*rows, strict=True) if rows else ((), (), ())
    lengths = [len(o) for o in other]
    flat = [np.concatenate(c) if rows else np.empty(0) for c in (other, score)]
    return pa.table(
        {
            "product_id": pa.array(np.repeat(np.array(own, dtype=object), lengths).tolist(), kind),
            "neighbor_id": pa.array(flat[0].tolist(), kind),
            "score": pa.array(flat[1], pa.float64()),
        }
    )


def numbered(names: DataFrame) -> DataFrame:
    """(feature, at): materialised distinct features with numbers from 0 on, without a gap."""
    own = names.select("feature", F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)
    counts = dict(own.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    at = F.element_at(F.lit(before or [0]).cast("array<bigint>"), part.cast("int") + 1) + (F.col("id") - F.shiftleft(part, 33))
    return own.select("feature", at.cast("int" if total < 1 << 31 else "bigint").alias("at"))


def laid_out(cells: DataFrame, metric: str, value: str | None, block_rows: int | None) -> DataFrame:
    """(product_id, block, at, w): one row per product, products of a heaviest feature next to each other.

    Features are numbers here, so that a copy of a product is small; Jaccard counts them, so all its weights are one. The
    rows are the only table that stays; steps before it leave the disk.
    """
    rows = cells.select("product_id", "feature", F.col(value or METRIC_COLUMN[metric]).alias("w")).filter("w <> 0")
    rows = materialise(rows, "rows")
    names = materialise(rows.select("feature").distinct(), "names")
    # The norm is summed once per product; summed over the list it would be taken anew for each of its cells.
    weights = {"cosine": lambda x: x["w"] / F.sqrt("squares"), "jaccard": lambda x: F.lit(1.0)}
    packed = attach(rows, numbered(names), ["feature"]).groupBy("product_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "w"))).alias("v"),
        F.max_by("feature", F.struct("w", "feature")).alias("home"),
        F.sum(F.col("w") * F.col("w")).alias("squares"),
    )
    w = F.transform("v", weights.get(metric, lambda x: x["w"]))
    packed = materialise(packed.select("product_id", "home", F.col("v.at").alias("at"), w.alias("w")), "products")
    discard(rows, names)
    n, total = packed.agg(F.count(F.lit(1)), F.sum(F.size("at"))).first()
    blocks = -(-n // block_rows) if block_rows else min(n, max(BLOCKS, -(-(total or 0) // BLOCK_CELLS)))
    # The first product of each block is told to all, so that the rows need not be dealt and written once more.
    place = F.struct("home", "product_id")
    dealt = packed.select("home", "product_id").repartitionByRange(max(1, blocks), "home", "product_id")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(place).alias("first")).select("first.*").sort("home", "product_id").collect()
    kinds = [packed.schema[c].dataType for c in ("home", "product_id")]
    later = [F.struct(*[F.lit(x).cast(k).alias(c) for x, k, c in zip(r, kinds, ("home", "product_id"))]) for r in firsts[1:]]
    block = F.size(F.filter(F.array(*later), lambda first: first <= place)) if later else F.lit(0)
    products = packed.select("product_id", block.alias("block"), "at", "w")
    products.__dict__["_table_path"] = packed.__dict__["_table_path"]
    return products


def searched_at_home(products: DataFrame, metric: str, top_n: int) -> DataFrame:
    """(product_id, neighbor_id, score): the best of each product in its own block."""

    def step(table: pa.Table) -> pa.Table:
        cells = Cells.of(table)
        rows = Lists.of(cells).search(cells, metric, top_n, np.zeros(len(cells.ids)))
        return _found(table.schema.field("product_id").type, rows)

    ship_package(products.sparkSession)
    id_type = products.schema["product_id"].dataType.simpleString()
    return products.groupBy("block").applyInArrow(step, f"product_id {id_type}, neighbor_id {id_type}, score double")


def floors_of(products: DataFrame, own: DataFrame, top_n: int) -> DataFrame:
    """``products`` with ``floor``: the score a neighbour in another block needs."""
    floor = F.when(F.count(F.lit(1)) >= top_n, F.min("score")).otherwise(0.0).alias("floor")
    floors = own.groupBy("product_id").agg(floor)
    if fits_broadcast(own.select("product_id").distinct().count(), 64):
        floors = F.broadcast(floors)
    return products.join(floors, "product_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))


def visits(products: DataFrame, own: DataFrame, metric: str, top_n: int) -> DataFrame:
    """(product_id, block, floor): the blocks that may hold more than a product has found at home."""
    cells = products.select("product_id", "block", F.explode(F.arrays_zip("at", "w")).alias("c"))
    cells = cells.select("product_id", "block", F.col("c.at").alias("at"), F.col("c.w").alias("w"))
    most = cells.groupBy(F.col("block").alias("other"), "at").agg(F.max("w").alias("m"))
    part: Column = F.least("w", "m") if metric == "overlap" else F.col("w") * F.col("m") if metric == "cosine" else F.lit(1.0)
    bounds = (
        cells.join(most, "at")
        .filter(F.col("other") != F.col("block"))
        .groupBy("product_id", F.col("other").alias("block"))
        .agg(F.sum(part).alias("bound"))
    )
    told = floors_of(products, own, top_n).select("product_id", F.size("at").alias("n"), "floor")
    open_ = F.col("bound") >= needed(F.col("floor"), F.col("n"), metric) - SLACK
    return bounds.join(told, "product_id").filter(open_).select("product_id", "block", "floor")


def meetings(blocks: int, turns: list[int]) -> list[tuple[int, int]]:
    """The pairs of blocks that lie so many blocks apart, counted in a circle: of all turns up to half the circle each pair is one."""
    return sorted({(min(i, j), max(i, j)) for t in turns for i in range(blocks) if (j := (i + t) % blocks) != i})


def searched_elsewhere(products: DataFrame, pairs: list[tuple[int, int]], metric: str, top_n: int) -> DataFrame:
    """(product_id, neighbor_id, score): the best of each product in the blocks that its own meets.

    ``products`` has their floors. A pair of blocks is one task, for both directions.
    """
    id_type = products.schema["product_id"].dataType

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            sides = [(Cells.of(t), t.column("floor").to_numpy()) for t in (left, right)]
            for (asking, floors), (members, _) in (sides, sides[::-1]):
                rows += Lists.of(members).search(asking, metric, top_n, floors)
        return _found(left.schema.field("product_id").type, rows)

    ship_package(products.sparkSession)
    spark = products.sparkSession
    sides = []
    # New names of the same columns keep the two sides of the cogroup apart.
    for side in (0, 1):
        route = spark.createDataFrame([(p[side], i) for i, p in enumerate(pairs)], "block int, meeting int")
        sent = products.join(F.broadcast(route), "block").select("meeting", *[F.col(c).alias(c) for c in ("product_id", "at", "w", "floor")])
        sides.append(sent.repartition(SPREAD * len(pairs), "meeting").groupBy("meeting"))
    schema = f"product_id {id_type.simpleString()}, neighbor_id {id_type.simpleString()}, score double"
    return sides[0].cogroup(sides[1]).applyInArrow(meet, schema)


def neighbors_of_all(
    cells: DataFrame, metric: str = "overlap", top_n: int = 10, value: str | None = None, block_rows: int | None = None
) -> DataFrame:
    """(product_id, rank, neighbor_id, score): what ``neighbors`` gives for every product, zero scores included.

    Scores compare at nine decimals and ties go to the lowest id. Weights are not negative; products without a weight
    have no row and are nobody's neighbour. Exact: blocks are left out only where a bound rules them out.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    products = laid_out(cells, metric, value, block_rows)
    id_type = products.schema["product_id"].dataType.simpleString()
    order = [F.col("score").desc(), F.col("neighbor_id").asc()]
    found = materialise(searched_at_home(products, metric, top_n), "found")
    blocks, total = products.agg(F.max("block") + 1, F.sum(F.size("at"))).first()
    turns = list(range(1, (blocks or 0) // 2 + 1))
    step = max(1, ROUND_CELLS // (2 * max(1, total or 0)))
    for i in range(0, len(turns), step):
        asking = floors_of(products, found, top_n)
        far = searched_elsewhere(asking, meetings(blocks, turns[i : i + step]), metric, top_n)
        better = materialise(top_rows(found.unionByName(far), ["product_id"], order, top_n), "found")
        discard(found)
        found = better
    # Products with fewer are filled up with zero scores of the lowest ids, of which so many suffice.
    some = products.select(F.col("product_id").alias("neighbor_id")).orderBy("neighbor_id").limit(2 * top_n + 1)
    lowest = F.lit([r["neighbor_id"] for r in some.collect()]).cast(f"array<{id_type}>")
    short = products.select("product_id").join(
        found.groupBy("product_id").count().filter(F.col("count") >= top_n), "product_id", "left_anti"
    )
    zeros = short.select("product_id", F.explode(lowest).alias("neighbor_id")).filter("product_id <> neighbor_id")
    zeros = zeros.join(found, ["product_id", "neighbor_id"], "left_anti").withColumn("score", F.lit(0.0))
    best = materialise(top_rows(found.unionByName(zeros), ["product_id"], order, top_n), "best")
    discard(found, products)
    rank = F.row_number().over(Window.partitionBy("product_id").orderBy(*order)).alias("rank")
    return best.select("product_id", rank, "neighbor_id", "score")


def visited_share(cells: DataFrame, metric: str = "overlap", top_n: int = 10, block_rows: int | None = None) -> float:
    """Blocks that products visit, their own included, as a share of products times blocks."""
    products = laid_out(cells, metric, None, block_rows)
    own = searched_at_home(products, metric, top_n)
    n = products.count()
    return (n + visits(products, own, metric, top_n).count()) / (n * products.select("block").distinct().count())
