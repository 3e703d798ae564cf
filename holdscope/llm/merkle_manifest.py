"""A Merkle manifest of a table, with a version of the tree for every leaf that was tampered with.

Leaves stand in groups, in order; runs of three become one node until one is left, the group's subroot, and the subroots
give the root alike. A tree is cut into aligned blocks of 3^8 leaves, each built in one task; the blocks' roots are the
leaves of the next round of blocks. Nodes are never changed: a tampered leaf makes a version of its block that copies its
ancestors and shares all other nodes. Upwards a version needs the siblings of its block alone, so these come down to the
block, and no task meets the versions of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256
from itertools import chain, groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import map_batches, materialise, shuffle_width

FANOUT, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a batch that a task gives back.
BATCH_ROWS = 2000


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def fold(leaf: str, steps: Sequence[str]) -> str:
    """The root above a leaf. ``steps`` has, for each level, the siblings before and those after."""
    for before, after in zip(steps[::2], steps[1::2], strict=True):
        leaf = digest(before + leaf + after)
    return leaf


class VersionedTree:
    """A tree of a block's leaves. Nodes are only added; a version is a root that shares what it does not change.

    With ``height`` every leaf is so many levels below the root, lone nodes having parents of their own; without, the
    tree ends where one node is left.
    """

    def __init__(self, leaves: Sequence[str], height: int | None = None):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = [list(range(len(leaves)))]
        while len(self.levels[-1]) > 1 if height is None else len(self.levels) <= height:
            below = self.levels[-1]
            self.levels.append([self._add(tuple(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
        self.root = self.levels[-1][0]

    def _add(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def version(self, place: int, leaf: str) -> int:
        """The root of a version with another leaf at ``place``: only the leaf and its ancestors are new nodes."""
        self.digests.append(leaf)
        self.children.append(())
        new = len(self.digests) - 1
        for below, level in pairwise(self.levels):
            old, place = below[place], place // FANOUT
            new = self._add(tuple(new if c == old else c for c in self.children[level[place]]))
        return new

    def steps(self, place: int) -> list[str]:
        """For each level the siblings before and after the leaf's ancestor, as joined digests."""
        out = []
        for level in self.levels[:-1]:
            run = place // FANOUT * FANOUT
            out.append("".join([self.digests[c] for c in level[run:place]]))
            out.append("".join([self.digests[c] for c in level[place + 1 : run + FANOUT]]))
            place //= FANOUT
        return out


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its number of bytes, a colon and its text."""
    framed = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*framed), 256)


def _placed(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """``items`` with ``pos``, their place in their group ``g``, from range partitions and the counts of the ones before."""
    dealt = items.repartitionByRange(shuffle_width(items.sparkSession), "g", *order).sortWithinPartitions("g", *order)
    numbered = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33).alias("_part")
    runs = numbered.groupBy("g", part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    met = numbered.withColumn("_part", part).join(runs, ["g", "_part"])
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_n", "_before")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """Rows in order; out come those of each block."""
    rows = chain.from_iterable(b.to_pylist() for b in batches)
    for (g, block), members in groupby(rows, key=lambda r: (r["g"], r["block"])):
        yield g, block, list(members)


NODES = "g string, block bigint, alone string, full string"


def _close(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """The root of each block, as the only block of its group and as one of several."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["g", "block", "alone", "full"])

    out = []
    for g, block, members in _blocks(batches):
        leaves = [r["digest"] for r in members]
        # Only a group's first block can be its only one.
        alone = VersionedTree(leaves) if block == 0 else None
        full = VersionedTree(leaves, height)
        out.append((g, block, alone.digests[alone.root] if alone else "", full.digests[full.root]))
        if len(out) >= BATCH_ROWS:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), "g", "block").sortWithinPartitions("g", "block", *order)


def _climb(items: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The items ``(g, pos, digest)`` of each round, and ``(g, rounds, digest)`` of each group's root."""
    rounds, tops = [], None
    while True:
        rounds.append(items)
        blocks = _by_block(items.select("g", F.expr(f"pos div {FANOUT**height}").alias("block"), "pos", "digest"), "pos")
        nodes = materialise(map_batches(blocks, partial(_close, height=height), NODES), "nodes")
        last = nodes.groupBy("g").agg(F.max("block").alias("last"))
        done = nodes.join(last.filter("last = 0"), "g").select("g", F.lit(len(rounds)).alias("rounds"), F.col("alone").alias("digest"))
        tops = done if tops is None else tops.unionByName(done)
        if not nodes.filter("block > 0").head(1):
            return rounds, tops
        items = nodes.join(last.filter("last > 0"), "g").select("g", F.col("block").alias("pos"), F.col("full").alias("digest"))


PATHS = "g string, pos bigint, subroot string, path array<string>"


def _trees(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[tuple[dict, list[dict], VersionedTree]]:
    """Each block's own row, which has the path above it, its leaves, and their tree."""
    for _, _, (own, *members) in _blocks(batches):
        yield own, members, VersionedTree([r["digest"] for r in members], None if own["alone"] else height)


def _spread(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """The path of each leaf: its siblings in the block, then the path of the block."""
    for own, members, tree in _trees(batches, height):
        for at in range(0, len(members), BATCH_ROWS):
            some = members[at : at + BATCH_ROWS]
            arrays = [
                pa.array([r["g"] for r in some], pa.string()),
                pa.array([r["pos"] for r in some], pa.int64()),
                pa.array([own["subroot"]] * len(some), pa.string()),
                pa.array([tree.steps(at + i) + own["path"] for i in range(len(some))], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["g", "pos", "subroot", "path"])


PROOFS = "doc_id bigint, leaf string, subroot string, path array<string>, changed_leaf string, folded_root string, n_copied bigint"


def _prove(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """The path of each leaf, and the root that its version, or else the leaf itself, leads to."""
    for own, members, tree in _trees(batches, height):
        for at in range(0, len(members), BATCH_ROWS):
            some = members[at : at + BATCH_ROWS]
            paths, folded, copied = [], [], []
            for place, row in enumerate(some, at):
                steps = tree.steps(place)
                if row["changed_leaf"] is None:
                    root = fold(row["digest"], steps)
                    copied.append(0)
                else:
                    root = tree.digests[tree.version(place, row["changed_leaf"])]
                    copied.append(1 + (len(steps) + len(own["path"])) // 2)
                folded.append(fold(root, own["path"]))
                paths.append(steps + own["path"])
            arrays = [
                pa.array([r["doc_id"] for r in some], pa.int64()),
                pa.array([r["digest"] for r in some], pa.string()),
                pa.array([own["subroot"]] * len(some), pa.string()),
                pa.array(paths, pa.list_(pa.string())),
                pa.array([r["changed_leaf"] for r in some], pa.string()),
                pa.array(folded, pa.string()),
                pa.array(copied, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PROOFS.split(", ")])


def _below(items: DataFrame, above: DataFrame, step, schema: str, height: int) -> DataFrame:
    """``step`` on each block of ``items``, led by the block's row ``(g, block, alone, subroot, path)`` of ``above``."""
    rows = above.withColumn("pos", F.lit(-1).cast("bigint")).unionByName(
        items.withColumn("block", F.expr(f"pos div {FANOUT**height}")), allowMissingColumns=True
    )
    return map_batches(_by_block(rows, "pos"), partial(step, height=height), schema)


def _descend(rounds: list[DataFrame], tops: DataFrame, step, schema: str, height: int) -> DataFrame:
    """From the paths above the groups' roots, ``(g, rounds, subroot, path)``, down to the first round's items."""
    paths = None
    for n in range(len(rounds), 0, -1):
        own = tops.filter(F.col("rounds") == n)
        above = own.select("g", F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("alone"), "subroot", "path")
        if paths is not None:
            above = above.unionByName(paths.select("g", F.col("pos").alias("block"), F.lit(False).alias("alone"), "subroot", "path"))
        last = n == 1
        paths = _below(rounds[n - 1], above, step if last else _spread, schema if last else PATHS, height)
    return paths


def manifest(
    docs: DataFrame,
    tampered: Column,
    tampered_text: Column,
    group_col: str = "source",
    fields: Sequence[str] = FIELDS,
    height: int = HEIGHT,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, changed_leaf, folded_root, n_copied, verified)`` of every row.

    ``fields`` names the id first and the text last; a leaf is the digest of them all. Per ``group_col`` leaves ascend by
    id, and every three consecutive nodes become their digest until one is left, the subroot; subroots in the order of
    groups give the root alike. ``path`` has the siblings of each level up to the root, those before and those after.
    Where ``tampered`` holds, ``changed_leaf`` is the leaf with ``tampered_text``, and ``folded_root`` the root of the
    version it makes with the original siblings, ``n_copied`` nodes of it new; elsewhere it is folded from the leaf.
    ``verified`` tells whether it is the root.

    A null field is a dash, so null and empty texts differ. The null group and null ids come first; a tampering condition
    that is null does not hold. Rows that share group and id are ordered by their leaf; equal rows are leaves of their
    own, next to each other. An empty table gives an empty table. Other columns are ignored. ``height`` is that of a block.
    """
    id_col, *_, text_col = fields
    as_text = {c: F.col(f"`{c}`").cast("string") for c in fields}
    changed = [*[as_text[c] for c in fields[:-1]], tampered_text]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("g"),
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        leaf_of(list(as_text.values())).alias("digest"),
        F.when(tampered, leaf_of(changed)).alias("changed_leaf"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # Equal rows are alike in every order; the tie only lets range partitions split them.
    items = _placed(materialise(leaves, "leaves"), ["doc_id", "digest", "tie"])
    rounds, tops = _climb(items.select("g", "pos", "digest"), height)
    rounds[0] = items.select("g", "pos", "doc_id", "digest", "changed_leaf")

    subroots = _placed(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "rounds", "digest"), ["name"])
    upper, top = _climb(subroots.select("g", "pos", "digest"), height)
    found = top.first()
    root = found["digest"] if found else None
    above = top.withColumn("subroot", F.lit(None).cast("string")).withColumn("path", F.array().cast("array<string>"))
    paths = _descend(upper, above, _spread, PATHS, height).select("pos", "path")
    tops = subroots.join(paths, "pos").select(F.col("name").alias("g"), "rounds", F.col("digest").alias("subroot"), "path")
    proofs = _descend(rounds, materialise(tops, "subroots"), _prove, PROOFS, height)
    return proofs.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "changed_leaf", "folded_root", "n_copied",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )
