"""Hard negatives of anchors, found through summaries of vector segments.

Of every vector the mean and the deviation of its segments are stored, for a few, more and many segments. The product of
two vectors lies within the sum over segments of (length * product of means) plus or minus (product of deviations). An
anchor goes through a block of rows by these bounds, coarse ones first; what they cannot decide is refined by the next
level, and only what is left is multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import map_batches, materialise
from holdscope.session import ship_package

#: Components are multiplied by this and cut to whole numbers.
SCALE = 256
#: Segments of each level; each cuts the segments of the one before.
SEGMENTS = (4, 16)
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares of the positive's.
LOW, HIGH, OF = 30, 90, 100
#: Rows of a block, and anchors that meet it in one task.
BLOCK_ROWS, ANCHOR_ROWS = 32_768, 65_536
#: Bounds are widened by this share, so that rounding never decides.
SLACK = 1e-9


def edges(dim: int, segments: int) -> np.ndarray:
    return np.arange(segments) * dim // segments


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment the mean times the root of its length, and the norm of the deviations from the mean."""
    segments = min(segments, x.shape[1]) or 1
    at = edges(x.shape[1], segments)
    length = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / length
    rest = x - np.repeat(mean, length, axis=1)
    return mean * np.sqrt(length), np.sqrt(np.add.reduceat(rest * rest, at, axis=1))


class Block:
    """Rows of a block with their summaries, by level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.labels, self.x, self.levels = ids, labels, x, levels
        #: Whether products may need more than the 53 bits of a double.
        self.large = len(x) > 0 and (x * x).sum(axis=1).max(initial=0) >= 2.0**53

    def bounds(self, level: int, rows: np.ndarray, anchor: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        (means, deviations), (mean, deviation) = self.levels[level], anchor[level]
        middle, reach = means[rows] @ mean, deviations[rows] @ deviation
        reach = reach + SLACK * (1 + np.abs(middle) + reach)
        return middle - reach, middle + reach

    def exact(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.large or (q * q).sum() >= 2.0**53:
            whole = [int(c) for c in q]
            return np.array([sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in self.x[rows]], np.int64)
        return (self.x[rows] @ q).astype(np.int64)

    def best(self, rows: np.ndarray, q: np.ndarray, anchor: list, windows: list[tuple[int, int]], k: int) -> list[np.ndarray]:
        """For each window of scores the first ``k`` of ``rows``, as their places in ``found``; ``found`` has rows and scores.

        A row goes as soon as its bounds show that it is in no window or behind ``k`` others in each.
        """
        low, high = np.array(windows, np.float64).reshape(-1, 2).T
        for level in range(len(self.levels)):
            if len(rows) <= k:
                break
            least, most = self.bounds(level, rows, anchor)
            stays = np.zeros(len(rows), bool)
            for a, b in zip(low, high, strict=True):
                sure = least[(least >= a) & (most <= b)]
                floor = max(a, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else a
                stays |= (most >= floor) & (least <= b)
            rows = rows[stays]
        scores = self.exact(rows, q)
        out = []
        for a, b in windows:
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            first = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][:k]
            out.append(np.stack([self.ids[rows[first]], scores[first]]))
        return out


def usable(vectors: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, label, v)`` with whole components, without rows that take no part; one row per id."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    )
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    rows = rows.filter(f"id is not null and label is not null and v is not null and {finite}")
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    one = Window.partitionBy("id").orderBy("label", "v")
    return rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")


def _packed(dim: int, segments: tuple[int, ...]):
    """Rows in; out come their components and, end to end, the summaries of all levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, dim)
                levels = np.hstack([part for s in segments for part in summaries(x, s)]) if dim else np.zeros((len(x), 0))
                arrays = [batch.column("id"), batch.column("label")]
                arrays += [pa.array([r.tobytes() for r in m.astype("<f8")], pa.binary()) for m in (x, levels)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "x", "levels"])

    return run


PACKED = "id bigint, label bigint, x binary, levels binary"


def _unpacked(table: pa.Table, dim: int, segments: tuple[int, ...]) -> Block:
    read = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), "<f8").reshape(table.num_rows, -1)
    levels, at, flat = [], 0, read("levels") if dim else None
    for s in segments if dim else ():
        n = min(s, dim)
        levels.append((flat[:, at : at + n].copy(), flat[:, at + n : at + 2 * n].copy()))
        at += 2 * n
    x = read("x") if dim else np.zeros((table.num_rows, 0))
    return Block(table.column("id").to_numpy(), table.column("label").to_numpy(), x, levels)


def _meet(index: DataFrame, anchors: DataFrame, facts: dict, step, schema: str) -> DataFrame:
    """``step(block, anchors)`` on each block of rows and turn of anchors."""
    n_blocks = max(1, -(-facts["rows"] // facts["block_rows"]))
    n_turns = max(1, -(-facts["anchors"] // ANCHOR_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = index.withColumn("block", deal(n_blocks)).withColumn("turn", every(n_turns))
    asked = anchors.withColumn("turn", deal(n_turns)).withColumn("block", every(n_blocks))
    ship_package(index.sparkSession)
    return rows.groupBy("block", "turn").cogroup(asked.groupBy("block", "turn")).applyInArrow(step, schema)


def mine(
    vectors: DataFrame,
    anchors: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    segments: tuple[int, ...] = SEGMENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``, exact for every anchor.

    A component x counts as floor(scale * x), a score is the whole inner product; higher scores come first, ties by
    smaller id. ``anchors`` is a condition on a column named ``id``, ``label`` a column of the input. An anchor's positives
    are the first other rows of its label; the negatives of each are the first rows of other labels whose score is between
    ``low`` and ``high`` hundredths of the positive's, so a positive of negative score has none.

    Rows with a null id, label or vector, or with null or non-finite components take no part, nor do vectors whose size is
    not the most common one (the smaller of equals). Of rows that share an id the smallest by label and vector counts.
    Zero and empty vectors score zero. An anchor without positives, or a positive without negatives, gives no row. Of equal
    vectors of a label only as many smallest ids as can be among anyone's first are compared. Other columns are ignored;
    an empty table gives an empty table. Scores must fit 64 bits; larger ones are an error.
    """
    rows = materialise(usable(vectors, label, id_col, vector_col, scale), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0
    rows = rows.filter(F.size("v") == dim)
    copies = Window.partitionBy("v", "label").orderBy("id")
    index = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= max(positives, negatives) + 1).drop("_n")
    index = materialise(map_batches(index, _packed(dim, segments), PACKED), "index")
    asked = materialise(map_batches(rows.filter(anchors), _packed(dim, segments), PACKED), "anchors")
    facts = {"rows": index.count(), "anchors": asked.count(), "block_rows": block_rows}

    def first_positives(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if members.num_rows and queries.num_rows:
            block, ask = _unpacked(members, dim, segments), _unpacked(queries, dim, segments)
            of = {int(c): np.flatnonzero(block.labels == c) for c in np.unique(block.labels)}
            for i, anchor in enumerate(ask.ids.tolist()):
                same = of.get(int(ask.labels[i]), np.empty(0, np.int64))
                same = same[block.ids[same] != anchor]
                mine_ = [(m[i], d[i]) for m, d in ask.levels]
                for ids, scores in block.best(same, ask.x[i], mine_, [(-(1 << 62), 1 << 62)], positives):
                    for column, values in zip(found, (np.full(len(ids), anchor), ids, scores), strict=True):
                        column.append(values)
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in found]
        return pa.table(columns, names=["anchor_id", "positive_id", "positive_score"])

    met = _meet(index, asked, facts, first_positives, "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= positives).drop("_n")
    chosen = materialise(chosen, "positives")
    wanted = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = asked.join(wanted, asked["id"] == wanted["anchor_id"]).drop("anchor_id")

    def first_negatives(members: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in range(5)]
        if members.num_rows and queries.num_rows:
            block, ask = _unpacked(members, dim, segments), _unpacked(queries, dim, segments)
            others = {int(c): np.flatnonzero(block.labels != c) for c in np.unique(ask.labels)}
            for i, (anchor, pairs) in enumerate(zip(ask.ids.tolist(), queries.column("positives").to_pylist(), strict=True)):
                # Equal scores have one window.
                scores = sorted({p["positive_score"] for p in pairs})
                windows = [(-(-low * s // OF), high * s // OF) for s in scores]
                mine_ = [(m[i], d[i]) for m, d in ask.levels]
                some = dict(zip(scores, block.best(others[int(ask.labels[i])], ask.x[i], mine_, windows, negatives), strict=True))
                for p in pairs:
                    ids, negative = some[p["positive_score"]]
                    values = (np.full(len(ids), anchor), np.full(len(ids), p["positive_id"]), ids)
                    values += (np.full(len(ids), p["positive_score"]), negative)
                    for column, value in zip(found, values, strict=True):
                        column.append(value)
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in found]
        return pa.table(columns, names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    schema = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    met = _meet(index, asked, facts, first_negatives, schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
