"""Repeatable appends and upserts as the sink of a file stream.

Collection is incremental by nature: new files land, and re-delivered rows must not change
the tables. The batch writes are functions of (table, new rows), so each micro-batch runs the
same code, and a batch replayed after a failure inserts nothing twice.

Rows of one key may meet in a batch, so their order matters: it is given by named columns or,
for a stream that comes straight from files, by the files' times, names and rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from holdscope.sources import store

FILE_ORDER = {
    "_time": "_metadata.file_modification_time",
    "_file": "_metadata.file_path",
    "_block": "_metadata.file_block_start",
}


def _ordered(stream: DataFrame, sequence: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """The stream with the columns that order its rows, and their names."""
    if sequence:
        return stream, list(sequence)
    return stream.select("*", *[F.col(c).alias(n) for n, c in FILE_ORDER.items()]), [*FILE_ORDER, "_row"]


def _numbered(batch: DataFrame) -> DataFrame:
    """Rows of a batch with a number that grows row by row within a block of a file."""
    return batch.withColumn("_row", F.monotonically_increasing_id())


def _start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(
    stream: DataFrame, root: str, table: str, checkpoint: str, sequence: Sequence[str] | None = None
) -> StreamingQuery:
    """Append the available new rows of a stream, skipping keys that are already stored; the first row of a key wins."""
    stream, arrival = _ordered(stream, sequence)

    def apply(batch: DataFrame, _: int) -> None:
        store.append_new(root, table, _numbered(batch), arrival)

    return _start(stream, apply, checkpoint)


def upsert_stream(
    stream: DataFrame, root: str, table: str, checkpoint: str, sequence: Sequence[str] | None = None
) -> StreamingQuery:
    """Upsert the available new rows of a stream by natural key; the last row of a key wins."""
    stream, arrival = _ordered(stream, sequence)

    def apply(batch: DataFrame, _: int) -> None:
        store.upsert(root, table, _numbered(batch), arrival)

    return _start(stream, apply, checkpoint)
