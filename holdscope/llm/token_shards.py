"""Token ids in training order: a keyed permutation of all sequences, written as shards of fixed stride.

The ids of the texts of a task follow each other, each text closed by an end id, and are cut into sequences of equal
length. A sequence's number among all is permuted by a Feistel network; values outside the range walk on along their
cycle until they fall inside. Slots are cut into ranges, and each range is one shard, sorted by slot, whose records all
have the same number of bytes. Any slot is found by a division, so a reader can go on from any step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.llm.common import map_batches, materialise, shared_path
from holdscope.llm.word_ids import word_table

LENGTH = 2048
END_ID = 1
#: Sequences of a shard.
SHARD_SEQUENCES = 4096
ROUNDS = 4
KEY = 20_240_517


def feistel(number: np.ndarray, total: int, key: int) -> np.ndarray:
    """A permutation of ``0 .. total - 1``, for numbers in that range."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = number.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for turn in range(ROUNDS):
            h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key + turn * 0xD1B54A32D192ED03) % (1 << 64))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= total]
    return x.astype(np.int64)


def unfeistel(slot: np.ndarray, total: int, key: int) -> np.ndarray:
    """The number that ``feistel`` brings to each slot."""
    half = max(1, (max(1, total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = slot.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for turn in reversed(range(ROUNDS)):
            h = left * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key + turn * 0xD1B54A32D192ED03) % (1 << 64))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right ^ ((h ^ (h >> np.uint64(29))) & mask), left
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= total]
    return x.astype(np.int64)


class Cutter:
    """Sequences of one task, in reading order."""

    def __init__(self, length: int):
        self.length = length
        self.parts: list[bytes] = []
        self.size = 0
        self.first: tuple[int | None, int] = (None, 0)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple[int | None, int, bytes]]:
        """Sequences that this document completes: the document it begins with, the place in that, and the ids."""
        at, total = 0, len(ids) // 4
        while at < total:
            if not self.size:
                self.first = (doc_id, at)
            part = ids[4 * at : 4 * (at + self.length - self.size)]
            self.parts.append(part)
            self.size += len(part) // 4
            at += len(part) // 4
            if self.size == self.length:
                yield self.flush()

    def flush(self) -> tuple[int | None, int, bytes]:
        out = (*self.first, b"".join(self.parts))
        self.parts, self.size = [], 0
        return out


SEQUENCES = "task int, n bigint, doc_id bigint, start bigint, n_tokens int, ids_crc32 bigint, packed binary"


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in schema.split(", ")])


def sequences(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int) -> DataFrame:
    """All sequences with their task and their number in it, written to the shared folder.

    ``packed`` holds the ids as compressed unsigned 16-bit integers, so that the shuffle stays small too; a larger id is
    refused.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cutter = word_table(tokenizer), Cutter(length)
        task, end = TaskContext.get().partitionId(), END_ID.to_bytes(4, "little")
        compress = zstandard.ZstdCompressor(level=3).compress
        found, n = [], 0

        def row(sequence: tuple[int | None, int, bytes]) -> tuple:
            doc_id, start, ids = sequence
            values = np.frombuffer(ids, "<u4")
            if values.max() > 0xFFFF:
                raise ValueError("token ids above 65535 do not fit a record")
            return task, n, doc_id, start, len(values), zlib.crc32(ids), compress(values.astype("<u2").tobytes())

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for sequence in cutter.add(doc_id, table.ids(text.as_py()) + end):
                    found.append(row(sequence))
                    n += 1
            if found:
                yield _batch(found, SEQUENCES, kinds)
                found = []
        if cutter.size:
            yield _batch([row(cutter.flush())], SEQUENCES, kinds)

    return materialise(map_batches(rows, run, SEQUENCES), "sequences")


def counted(found: DataFrame) -> tuple[dict[int, int], int]:
    """The sequences before each task and their total. One count per task comes to the driver, as for ``zipWithIndex``."""
    begin, total = {}, 0
    for r in found.groupBy("task").count().orderBy("task").collect():
        begin[r["task"]], total = total, total + r["count"]
    return begin, total


def with_slots(found: DataFrame, begin: dict[int, int], total: int, key: int, length: int, shard_sequences: int) -> DataFrame:
    """``slot``, ``shard`` and ``offset`` in front of the columns of ``found``, in place of ``task`` and ``n``."""
    stride = 2 * length + 1
    kept = [c for c in found.columns if c not in ("task", "n")]
    names = ["slot", "shard", "offset", *kept]
    schema = "slot bigint, shard int, offset bigint" + "".join(f", {c} {found.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.array([begin[t] for t in batch.column("task").to_pylist()], np.int64)
            slot = feistel(first + batch.column("n").to_numpy(), total, key)
            shard, place = slot // shard_sequences, slot % shard_sequences
            columns = [pa.array(slot), pa.array(shard.astype(np.int32)), pa.array(place * stride)]
            yield pa.RecordBatch.from_arrays([*columns, *[batch.column(c) for c in kept]], names)

    return map_batches(found, run, schema)


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    key: int = KEY,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    shard_sequences: int = SHARD_SEQUENCES,
) -> tuple[DataFrame, str]:
    """Write the shards; give ``(slot, shard, offset, doc_id, start, n_tokens, ids_crc32)`` of every sequence, and the path.

    ``path/shard=N`` holds one file of records in slot order: ``2 * length`` bytes of little-endian unsigned 16-bit
    ids, padded with zeros, then a line feed. Slot s is record ``s % shard_sequences`` of shard ``s // shard_sequences``
    and begins there at byte ``offset``. ``doc_id`` and ``start`` tell with which document, and where in it, a sequence
    begins; ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers.

    A null text is empty: its end id alone. A null id stays null. Repeated rows are documents of their own. Only the last
    sequence of a task may be short. An empty table writes no record. Other columns are ignored. Which texts share a
    sequence depends on how the table is split into tasks; the permutation depends on the key and the number of
    sequences alone.
    """
    path = path or shared_path(docs.sparkSession, "shards")
    found = sequences(docs, tokenizer, id_col, text_col, length)
    begin, total = counted(found)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            records = [decompress(p).ljust(2 * length, b"\0") for p in batch.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("slot"), batch.column("shard"), pa.array(records, pa.binary())], ["slot", "shard", "record"]
            )

    packed = with_slots(found.select("task", "n", "packed"), begin, total, key, length, shard_sequences)
    dealt = packed.drop("offset").repartitionById(max(1, -(-total // shard_sequences)), "shard")
    records = map_batches(dealt, unpack, "slot bigint, shard int, record binary").sortWithinPartitions("shard", "slot")
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").text(path)
    # The manifest reads and ships no ids.
    return with_slots(found.drop("packed"), begin, total, key, length, shard_sequences), path


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, first: int = 0) -> DataFrame:
    """``(slot, ids)`` of all slots from ``first`` on; shards before it are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    stride = 2 * length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                slots = range(shard * shard_sequences, shard * shard_sequences + len(content) // stride)
                ids = [np.frombuffer(content, "<u2", length, i * stride).tolist() for i in range(len(slots))]
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["slot", "ids"])

    # ``shard`` is the partition column, so the filter is settled before any file is opened.
    wanted = files.filter(F.col("shard") >= first // shard_sequences).select(F.col("shard").cast("int").alias("shard"), "content")
    return map_batches(wanted, run, "slot bigint, ids array<int>").filter(F.col("slot") >= first)
