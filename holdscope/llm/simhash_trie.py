"""Near-duplicate documents by SimHash fingerprints and a binary trie joined with itself.

Fingerprints are read as paths of a binary trie. A pair of nodes is walked together; the bits in which
their paths differ are added up, and a pair is given up when they exceed the budget. The top of the trie
is cut into cells of bounded size; each pair of cells within the budget is walked by the task that owns
its first cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import ascii_words, key_of, map_batches, map_groups, materialise, ragged_ranges, text_bytes
from holdscope.llm.components import components

SEED = 42
BITS = 64
#: A cell of the trie's top holds about this many distinct fingerprints, or a 2,048th of them if that is more.
CELL_ROWS = 4096
#: Node pairs with so few fingerprint pairs below them are compared directly.
LEAF_PAIRS = 24
#: Node pairs that are walked at a time; more are taken in turns.
FRONTIER = 1 << 20


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; a shorter text is one run."""
    parts = ascii_words(text)
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; nothing sets none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, key, fingerprint)`` of every row; the fingerprint's bits are held as a bigint."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        key_of(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [majority_bits(shingle_hashes(t, words)) for t in text_bytes(batch.column("text"))]
            prints = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), prints], ["doc_id", "key", "fingerprint"]
            )

    return map_batches(rows, of, "doc_id bigint, key bigint, fingerprint bigint")


# --- the trie ---------------------------------------------------------------------------------------


def cells(prints: DataFrame, cell_rows: int = CELL_ROWS) -> np.ndarray:
    """Where the cells of the trie's top begin, as sorted unsigned fingerprints.

    Nodes above ``cell_rows`` fingerprints are counted 8 bits deeper, again and again. What comes to the driver
    is one count per node of the top: at most 256 for each node that is cut.
    """
    total = prints.count()
    limit = max(cell_rows, total // 2048)
    starts, open_nodes, depth = [0], [(0, total)], 0
    while depth < BITS and any(n > limit for _, n in open_nodes):
        big = [p for p, n in open_nodes if n > limit]
        shift = BITS - depth - 8
        node = F.shiftrightunsigned("fingerprint", shift)
        counted = prints.select(node.alias("node"))
        if depth:
            parents = prints.sparkSession.createDataFrame(
                [(p - (1 << 64) if p >= 1 << 63 else p,) for p in big], "parent bigint"
            )
            counted = counted.join(parents, F.shiftrightunsigned("node", 8) == F.col("parent"), "left_semi")
        found = [(r["node"] % (1 << 64), r["n"]) for r in counted.groupBy("node").agg(F.count("*").alias("n")).collect()]
        open_nodes = _merged(found, limit)
        starts += [p << shift for p, _ in open_nodes]
        open_nodes = [(p, n) for p, n in open_nodes if n > limit]
        depth += 8
    return np.unique(np.array(starts, np.uint64))


def _merged(nodes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """Sibling nodes of 8 bits become one subtrie while they hold no more than ``limit``."""
    level = {p: (n, p) for p, n in nodes}
    for step in range(8):
        up: dict[int, tuple[int, int]] = {}
        for p, (n, first) in sorted(level.items()):
            mate = up.get(p - (p & (1 << step)))
            key = p - (p & (1 << step))
            if mate and mate[0] + n <= limit:
                up[key] = (mate[0] + n, mate[1])
            elif mate:
                up[p] = (n, first)
            else:
                up[key if n <= limit else p] = (n, first if n > limit else key)
        level = up
    return sorted((first, n) for n, first in level.values())


def _least_difference(starts: np.ndarray, budget: int) -> list[np.ndarray]:
    """For each cell, the cells from it on that may hold a fingerprint within the budget.

    Whole cells are compared by the bits that both fix; a cell's path is what its first and last value share.
    """
    last = np.append(starts[1:] - np.uint64(1), np.uint64(2**64 - 1))
    loose = starts ^ last
    for shift in (1, 2, 4, 8, 16, 32):
        loose = loose | (loose >> np.uint64(shift))
    fixed = ~loose
    out = []
    for i in range(len(starts)):
        differ = (starts[i] ^ starts[i:]) & fixed[i] & fixed[i:]
        out.append(i + np.flatnonzero(np.bitwise_count(differ) <= budget))
    return out


class _Trie:
    """Sorted fingerprints of a task, walked as a trie; labels join what is already linked."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.label = np.arange(len(prints))
        self.links: list[tuple[int, int]] = []
        self._zeros: dict[int, np.ndarray] = {}
        self._runs()

    def _runs(self) -> None:
        change = np.flatnonzero(np.diff(self.label)) + 1
        ends = np.append(change, len(self.label))
        self.run_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))

    def zeros(self, level: int) -> np.ndarray:
        if level not in self._zeros:
            bit = (self.prints >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            self._zeros[level] = np.concatenate([[0], np.cumsum(bit == 0, dtype=np.int32)]).astype(np.int32)
        return self._zeros[level]

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        """Keep only links between parts that are not joined yet: a forest, never all pairs."""
        parent = self.label
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            link = (a, b)
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                self.links.append(link)

    def settle(self) -> None:
        while True:
            up = self.label[self.label]
            if np.array_equal(up, self.label):
                break
            self.label = up
        self._runs()

    def walk(self, pairs: np.ndarray, budget: int) -> None:
        """Walk node pairs ``(a_lo, a_hi, b_lo, b_hi)`` from the root's level down."""
        stack = [(0, pairs.astype(np.int32), np.zeros(len(pairs), np.int8))]
        while stack:
            level, nodes, differ = stack.pop()
            if len(nodes) > FRONTIER:
                half = len(nodes) // 2
                stack += [(level, nodes[:half], differ[:half]), (level, nodes[half:], differ[half:])]
                continue
            a_lo, a_hi, b_lo, b_hi = nodes.T
            joined = (self.run_end[a_lo] >= a_hi) & (self.run_end[b_lo] >= b_hi) & (self.label[a_lo] == self.label[b_lo])
            few = (a_hi - a_lo).astype(np.int64) * (b_hi - b_lo) <= LEAF_PAIRS
            self.compare(nodes[few & ~joined], budget)
            rest = ~(few | joined)
            if level == BITS or not rest.any():
                continue
            nodes, differ = nodes[rest], differ[rest]
            a_lo, a_hi, b_lo, b_hi = nodes.T
            z = self.zeros(level)
            a_mid, b_mid = a_lo + z[a_hi] - z[a_lo], b_lo + z[b_hi] - z[b_lo]
            same = (a_lo == b_lo) & (a_hi == b_hi)
            below, spent = [], []
            for a1, a2, b1, b2, cost in (
                (a_lo, a_mid, b_lo, b_mid, 0),
                (a_mid, a_hi, b_mid, b_hi, 0),
                (a_lo, a_mid, b_mid, b_hi, 1),
                (a_mid, a_hi, b_lo, b_mid, 1),
            ):
                go = (a1 < a2) & (b1 < b2) & (differ + cost <= budget)
                if cost and a1 is a_mid:
                    go &= ~same  # the mirrored pair of a node with itself
                below.append(np.stack([a1[go], a2[go], b1[go], b2[go]], axis=1))
                spent.append(differ[go] + np.int8(cost))
            stack.append((level + 1, np.concatenate(below), np.concatenate(spent)))

    def compare(self, nodes: np.ndarray, budget: int) -> None:
        if not len(nodes):
            return
        a_lo, a_hi, b_lo, b_hi = nodes.astype(np.int64).T
        width = b_hi - b_lo
        count = (a_hi - a_lo) * width
        k = ragged_ranges(np.zeros(len(nodes)), count)
        width = np.repeat(width, count)
        u = np.repeat(a_lo, count) + k // width
        v = np.repeat(b_lo, count) + k % width
        near = (np.bitwise_count(self.prints[u] ^ self.prints[v]) <= budget) & (u != v)
        self.join(u[near], v[near])


def trie_links(prints: np.ndarray, own: tuple[int, int], others: list[tuple[int, int]], budget: int) -> np.ndarray:
    """A spanning forest of the links of ``prints[own]`` among themselves and with the other ranges.

    ``prints`` are sorted and distinct. A first walk with a budget of one bit joins dense groups, so that the full
    walk can skip node pairs that are joined already; it need not visit all pairs of such a group.
    """
    trie = _Trie(prints)
    ranges = [own, *others]
    pairs = np.array([(*own, *r) for r in ranges if r[0] < r[1] and own[0] < own[1]], np.int64).reshape(-1, 4)
    for bits in sorted({min(1, budget), budget}):
        trie.walk(pairs, bits)
        trie.settle()
    return prints[np.array(trie.links, np.int64).reshape(-1, 2)]


def near_links(prints: DataFrame, budget: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(u, v)`` that connect what lies within ``budget`` differing bits; distinct non-null prints in.

    The fingerprints of a cell are packed into one block. A cell's task gets its own block and those of later cells
    that the budget can reach. The links of a task are a forest: fingerprints it has joined already get no further link.
    """
    spark = prints.sparkSession
    starts = cells(prints, cell_rows)
    reach = _least_difference(starts, budget)
    owners: list[list[int]] = [[] for _ in starts]
    for i, js in enumerate(reach):
        for j in js.tolist():
            owners[j].append(i)
    ragged = np.concatenate([np.array(o, np.int32) for o in owners])
    sizes = np.array([len(o) for o in owners])
    firsts = np.cumsum(sizes) - sizes
    routes = spark.sparkContext.broadcast((starts, ragged, firsts, sizes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = routes.value[0]
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            cell = np.searchsorted(starts, values.view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(values)], ["cell", "fingerprint"])

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, ragged, firsts, sizes = routes.value
        me = key[0].as_py()
        block = np.sort(table.column("fingerprint").to_numpy().view(np.uint64)).tobytes()
        to = ragged[firsts[me] : firsts[me] + sizes[me]]
        return pa.table({"owner": pa.array(to), "block": pa.array([block] * len(to), pa.binary())})

    def walk(key: tuple, table: pa.Table) -> pa.Table:
        starts = routes.value[0]
        me = key[0].as_py()
        values = np.sort(np.frombuffer(b"".join(table.column("block").to_pylist()), np.uint64))
        cell = np.searchsorted(starts, values, side="right") - 1
        edges = np.flatnonzero(np.diff(cell)) + 1
        bounds = np.concatenate([[0], edges, [len(values)]])
        ranges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        own = [r for r in ranges if cell[r[0]] == me]
        rest = [r for r in ranges if cell[r[0]] != me]
        found = trie_links(values, own[0], rest, budget) if own else np.empty((0, 2), np.uint64)
        found = np.ascontiguousarray(found).view(np.int64)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    placed = map_batches(prints.select("fingerprint"), place, "cell int, fingerprint bigint")
    sent = map_groups(placed, ["cell"], send, "owner int, block binary")
    return map_groups(sent, ["owner"], walk, "u bigint, v bigint").distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 3, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``(doc_id, key, fingerprint, component_id, root)`` of every row.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id reachable over links of at most ``budget``
    bits, ``root`` names the component even if all its ids are null. ``key`` is a hash of id and text.

    A null text is empty, and empty texts have fingerprint zero, which links like any other. A null id keeps its row
    and takes no part in the smallest id. Repeated rows each return. An empty table gives an empty table. Other
    columns are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct.select("fingerprint"), budget, cell_rows))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    # Few rows per component remain after the first aggregation, but a component may be large: aggregate, then join.
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fingerprint", "root", "component_id")
    return rows.join(classes, "fingerprint").select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays (nulls last, then by text hash)."""
    return keep_first(docs, near_groups(docs, id_col, text_col, **kwargs), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each root in ``groups`` (``doc_id``, ``key`` and ``root`` of every row)."""
    first = groups.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    )
    keep = first.select("first.doc_id", "first.key").withColumnsRenamed({"doc_id": "_keep_id", "key": "_keep_key"})
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        key_of(F.col(id_col), F.col(text_col)).alias("_key"),
        F.col(id_col).cast("bigint").alias("_id"),
    )
    kept = rows.join(
        keep, (F.col("_key") == F.col("_keep_key")) & F.col("_id").eqNullSafe(F.col("_keep_id")), "left_semi"
    )
    one = Window.partitionBy("_key").orderBy("_id")
    return kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")
