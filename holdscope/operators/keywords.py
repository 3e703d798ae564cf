"""Keyword search through trigrams: which rows may hold a substring, told by bitmaps before any text is read.

The index has, for each trigram of the searched texts in small letters and each bucket of 32,768 row numbers, a bitmap of
the rows that hold it. A keyword's rows are among those in the bitmaps of all of its trigrams; they are verified by the
same ``ilike`` as a plain search, in which ``%`` and ``_`` of the keyword are wild cards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions.text import match_any

GRAM = 3
#: Row numbers of a bitmap.
BUCKET = 32_768


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``bucket`` and ``bit``, where the bitmaps have the row number ``key``, which is not negative."""
    place = F.col(key).cast("bigint") + 1
    return rows.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})


def _grams(text: Column) -> Column:
    """All trigrams of a text; none of a null or shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    cut = F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM)))
    return F.when(F.length(text) >= GRAM, cut).otherwise(F.array().cast("array<string>"))


def trigram_index(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(gram, bucket, rows): for every trigram of any of ``columns`` a bitmap per bucket. Null texts have none."""
    grams = F.flatten(F.array(*[_grams(F.lower(F.col(c))) for c in columns]))
    found = numbered(rows, key).select("bucket", "bit", F.explode(F.array_distinct(grams)).alias("gram"))
    return found.groupBy("gram", "bucket").agg(F.bitmap_construct_agg("bit").alias("rows"))


def keyword_grams(keyword: str) -> list[str]:
    """Distinct trigrams of the literal parts of a keyword; none if all parts are shorter."""
    parts = re.split("[%_]", keyword.strip().lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def candidates(index: DataFrame, keyword: str) -> DataFrame | None:
    """(bucket, bit) of the rows that may match; nothing if the keyword has no trigram, so that all rows may."""
    grams = keyword_grams(keyword)
    # A backslash escapes in a pattern; small letters beyond ASCII may differ between this process and the engine.
    if not grams or "\\" in keyword or not keyword.isascii():
        return None
    held = index.filter(F.col("gram").isin(grams)).groupBy("bucket")
    both = held.agg(F.bitmap_and_agg("rows").alias("rows"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    # The bytes of a bitmap that have bits, and of each byte the places of its bits.
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 8 - 1)), lambda i: F.struct(i.alias("byte"), F.substr(F.hex("rows"), 2 * i + 1, F.lit(2)).alias("hex")))
    bits = both.select("bucket", F.explode(F.filter(bytes_, lambda x: x["hex"] != "00")).alias("b")).select("bucket", "b.*")
    value = F.conv("hex", 16, 10).cast("int")
    eight = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.getbit(value, F.lit(i)).alias("on")) for i in range(8)]), lambda x: x["on"] == 1)
    eight = F.transform(eight, lambda x: x["i"])
    return bits.select("bucket", F.explode(F.transform(eight, lambda i: F.col("byte") * 8 + i)).alias("bit"))


def search(rows: DataFrame, index: DataFrame, key: str, columns: Sequence[str], keyword: str) -> DataFrame:
    """The rows whose ``columns`` hold the keyword, whatever the case; keywords without a trigram scan all rows."""
    some = candidates(index, keyword)
    matches = match_any([F.col(c) for c in columns], keyword)
    if some is None:
        return rows.filter(matches)
    return numbered(rows, key).join(some, ["bucket", "bit"], "left_semi").select(*rows.columns).filter(matches)
