"""Bounded-space packing of documents into training sequences.

A task reads its documents once and keeps a fixed number of open windows. A document goes into the window that it
leaves fullest; when it fits into none, the fullest window is emitted. What is open at the end of a task is merged
there, and the last, partly filled window of each task is merged with those of other tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import map_batches, map_groups, materialise
from holdscope.llm.word_ids import word_table

WINDOW = 2048
OPEN_WINDOWS = 64
#: A window that is emitted with a larger gap is first filled with the beginning of the next document.
MAX_GAP = 48
#: Leftover windows of so many tasks are merged by one task; this repeats until one group is left.
MERGED_TASKS = 1024
#: Id after each document.
END_ID = 1

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "window bigint, offset bigint, fill int, leftover boolean, ids binary"
)


class Packer:
    """Open windows of one task. A piece is ``(doc_id, start, ids, doc_tokens)`` with ids as bytes."""

    def __init__(self, first_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP):
        self.next_id, self.window, self.limit, self.max_gap = first_id, window, open_windows, max_gap
        self.spaces: list[tuple[int, int]] = []  # (free ids, slot), in order
        self.slots: dict[int, list[tuple]] = {}
        self.opened = 0
        self.done: list[tuple[int, int, bool, list[tuple]]] = []

    def emit(self, pieces: list[tuple], leftover: bool = False) -> None:
        fill = sum(len(p[2]) for p in pieces) // 4
        self.done.append((self.next_id, fill, leftover, pieces))
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.emit([(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)])
            start += self.window
        if start < total:
            self.place((doc_id, start, ids[4 * start :], total))

    def place(self, piece: tuple) -> None:
        doc_id, start, ids, total = piece
        need = len(ids) // 4
        at = bisect_left(self.spaces, (need, -1))
        if at < len(self.spaces):
            space, slot = self.spaces.pop(at)
            self.slots[slot].append(piece)
            if space == need:
                self.emit(self.slots.pop(slot))
            else:
                insort(self.spaces, (space - need, slot))
            return
        if len(self.spaces) >= self.limit:
            space, slot = self.spaces.pop(0)
            fullest = self.slots.pop(slot)
            if space > self.max_gap:
                fullest.append((doc_id, start, ids[: 4 * space], total))
                self.emit(fullest)
                self.place((doc_id, start + space, ids[4 * space :], total))
                return
            self.emit(fullest)
        self.opened += 1
        self.slots[self.opened] = [piece]
        insort(self.spaces, (self.window - need, self.opened))

    def finish(self) -> None:
        """Join the open windows end to end and cut them anew; only the last may stay partly filled."""
        pieces = [p for _, slot in self.spaces for p in self.slots[slot]]
        self.spaces, self.slots = [], {}
        now, free = [], self.window
        for doc_id, start, ids, total in pieces:
            while ids:
                part, ids = ids[: 4 * free], ids[4 * free :]
                now.append((doc_id, start, part, total))
                start += len(part) // 4
                free -= len(part) // 4
                if not free:
                    self.emit(now)
                    now, free = [], self.window
        if now:
            self.emit(now, leftover=True)

    def rows(self, with_ids: bool) -> pa.RecordBatch | None:
        """The emitted pieces so far, as a batch."""
        out: list[list] = [[] for _ in range(10)]
        for window, fill, leftover, pieces in self.done:
            offset = 0
            for doc_id, start, ids, total in pieces:
                size = len(ids) // 4
                row = (doc_id, start, size, zlib.crc32(ids), total, window, offset, fill, leftover, ids if with_ids else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                offset += size
        self.done = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.binary()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names) if out[0] else None


def merge_windows(fills: list[tuple[int, int]], window: int, keep: int) -> list[tuple[int, int, int, int, bool]]:
    """Best-fit of whole windows ``(id, fill)``, largest first: ``(id, new id, base offset, new fill, open)``.

    Of the merged windows the ``keep`` emptiest stay open for the next round.
    """
    spaces: list[tuple[int, int]] = []
    members: dict[int, list[tuple[int, int]]] = {}
    for name, fill in sorted(fills, key=lambda x: (-x[1], x[0])):
        at = bisect_left(spaces, (fill, -(1 << 62)))
        space, into = spaces.pop(at) if at < len(spaces) else (window, name)
        members.setdefault(into, []).append((name, window - space))
        insort(spaces, (space - fill, into))
    still_open = {into for space, into in spaces[len(spaces) - keep :] if space} if keep else set()
    return [
        (name, into, base, window - space, into in still_open) for space, into in spaces for name, base in members[into]
    ]


def _merge_group(window: int, keep: int):
    def merge(table: pa.Table) -> pa.Table:
        fills = list(zip(*(table.column(c).to_pylist() for c in ("into", "fill")), strict=True))
        columns = list(zip(*merge_windows(fills, window, keep), strict=True))
        kinds = {"into": pa.int64(), "new": pa.int64(), "shift": pa.int64(), "new_fill": pa.int32(), "new_open": pa.bool_()}
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return merge


def _merged(leftovers: DataFrame, tasks: int, window: int, keep: int) -> DataFrame | None:
    """Where each leftover window goes: ``(window, sequence_id, base)``."""
    moves = leftovers.selectExpr("window", "window as into", "0L as base", "fill", "true as open")
    groups = tasks
    while groups > 0:
        groups = -(-groups // MERGED_TASKS)
        last = groups == 1
        span = MERGED_TASKS ** _rounds(tasks, groups)

        merge = _merge_group(window, 0 if last else keep)
        now = moves.filter("open").select("into", "fill").distinct()
        merged = map_groups(
            now,
            [F.expr(f"shiftright(into, 32) div {span}").alias("group")],
            merge,
            "into bigint, new bigint, shift bigint, new_fill int, new_open boolean",
        )
        moves = materialise(
            moves.join(merged, "into", "left").select(
                "window",
                F.coalesce("new", "into").alias("into"),
                (F.col("base") + F.coalesce("shift", F.lit(0))).alias("base"),
                F.coalesce("new_fill", "fill").alias("fill"),
                F.coalesce("new_open", F.lit(False)).alias("open"),
            ),
            "windows",
        )
        if last:
            break
    return moves.select("window", F.col("into").alias("sequence_id"), "base", "fill")


def _rounds(tasks: int, groups: int) -> int:
    n = 0
    while tasks > groups:
        tasks, n = -(-tasks // MERGED_TASKS), n + 1
    return max(n, 1)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    max_gap: int = MAX_GAP,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, fill``.

    ``tokenizer`` is the file of a tokenizer that drops white space and does not join across it. A document is its ids
    and a final 1. ``fill`` is how many ids the sequence holds; ``with_ids`` adds the piece's ids as little-endian
    unsigned 32-bit integers.

    A null text is empty: one piece with the end id. A null id stays null. Repeated rows are documents of their own.
    Documents longer than a window are cut into whole windows and a rest. An empty table gives an empty table; other
    columns are ignored. Which sequence a piece comes to depends on how the table is split into tasks.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows, max_gap)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, table.ids(text.as_py()) + end)
            if found := packer.rows(with_ids):
                yield found
        packer.finish()
        if found := packer.rows(with_ids):
            yield found

    pieces = materialise(map_batches(rows, run, SCHEMA), "pieces")
    leftovers = pieces.filter("leftover").select("window", "fill").distinct()
    tasks = pieces.agg(F.max(F.shiftright("window", 32))).first()[0]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "fill"]
    columns += ["ids"] if with_ids else []
    whole = pieces.filter("not leftover").withColumn("sequence_id", F.col("window")).select(columns)
    if tasks is None:
        return whole
    moves = _merged(leftovers, tasks + 1, window, open_windows)
    rest = (
        pieces.filter("leftover")
        .drop("fill")
        .join(moves, "window")
        .withColumn("offset", F.col("offset") + F.col("base"))
    )
    return whole.unionByName(rest.select(columns))
