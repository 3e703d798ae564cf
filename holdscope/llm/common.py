"""Shared pieces: internal column names, ASCII words, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdscope.session import discard as discard
from holdscope.session import materialise as materialise
from holdscope.session import shared_path as shared_path
from holdscope.session import ship_package

#: Bytes of an ASCII capital letter become its small letter; all other bytes stay.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Bytes of a batch that a Python worker is given at a time.
BATCH_BYTES = 8 << 20


def _ready(spark: SparkSession) -> None:
    """This package at hand in the workers, and batches of whole texts bounded by bytes, not by rows alone."""
    ship_package(spark)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(limit, str(BATCH_BYTES))


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    _ready(df.sparkSession)
    return df.mapInArrow(step, schema)


def map_groups(df: DataFrame, keys: Sequence[str | Column], step: Callable, schema: str) -> DataFrame:
    """``applyInArrow`` on each group."""
    _ready(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(step, schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    binary = column.cast(pa.large_binary())
    for value in binary:
        yield value.as_py() or b""


def ascii_words(text: bytes) -> list[bytes]:
    """Words between the ASCII white space 0x20 and 0x09-0x0D, with A-Z made small."""
    return text.translate(ASCII_LOWER).split()


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of each length, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths) + np.repeat(
        np.asarray(starts, dtype=np.int64), lengths
    )


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def packed_row(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    """All columns of a row as one struct, so that no extra column can clash with an internal name."""
    return F.struct(*[F.col(f"`{c}`") for c in (names or df.columns)])


def key_of(doc_id: Column, text: Column) -> Column:
    """A row's key: rows that repeat both id and text share it."""
    return F.xxhash64(doc_id, text)


#: Bits of a bitmap of keys.
BITMAP_BITS = 1 << 27


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the bigint column ``key``, of bounded size: keys that share a place are taken together."""
    place = F.pmod("key", F.lit(BITMAP_BITS)) + 1
    rows = keys.select(place.alias("p")).select(F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("bit"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        begin = (r["bucket"] - 1) * len(r["bits"])
        out[begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = np.mod(keys, BITMAP_BITS)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & np.uint8(1) == 1
