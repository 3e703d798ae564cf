"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the operators use inside.
CLASHING = (
    "key", "row", "bucket", "place", "next", "line", "fingerprint", "slot", "kind", "n", "id", "pos", "at", "start",
    "_id", "_key", "_row", "v", "lang_pred", "score", "owner", "cell", "levels", "task", "shard", "window", "removed",
)


def rows(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    words = ["the", "of", "Thanon", "éleai", "straße", "naïve", "ti,", "x", "中文", "a.b", "co-op", "1984", "Thntblere"]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 90))) for _ in range(12)]
    near = texts[0].replace("the", "teh", 1)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \n\t "), (4, "!!! ... 123"), (5, texts[0]), (6, texts[0]), (7, near), (8, "a"),
        (9, passage), (10, texts[1] + "\n" + passage), (11, passage + "\n" + texts[2]), (None, texts[3]),
        (None, None), (12, texts[4]), (12, texts[4]), (12, texts[5]), (13, "ab " * 30_000), (14, "z" * 50_000),
        (15, "one line\none line\n\none line."), (2**62, texts[6]), (-5, texts[7]), (16, "\x1c nul\x00 \x1f"),
        (17, "a <|endoftext|> b<|ENDOFTEXT|> <|endoftext"), (18, "<|startoftext|><|endoftext|>é<|endoftext|>\u0301's"),
        (19, "² ½ Ⅷ ①"), (2**63 - 1, texts[3]), (2**63 - 1, passage),
    ]
    out += [(20 + i, t) for i, t in enumerate(texts)]
    rnd.shuffle(out)
    return out


def table(spark: SparkSession, data: list[tuple[int | None, str | None]] | None = None, parts: int = 3) -> DataFrame:
    """The rows as documents with a language and columns whose names clash with internal ones."""
    docs = spark.createDataFrame(rows() if data is None else data, "doc_id bigint, text string").repartition(parts)
    docs = docs.withColumn("lang", F.when(F.length("text") % 2 == 0, "en").when(F.length("text") % 3 == 0, "fr"))
    return docs.withColumns({name: F.lit(f"clash {name}") for name in CLASHING})


def order(data: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    return sorted(data, key=lambda r: (r[0] is None, r[0] or 0))


def left(spark: SparkSession) -> set[tuple[str, str]]:
    """Name and path of every table in the shared folder."""
    folder = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    return {(x.rsplit("-", 1)[0], x) for x in (os.listdir(folder) if folder else ())}


def shuffle_files(spark: SparkSession, at_most: int = 0) -> int:
    """The shuffle files on local disks; Spark removes them a moment later, so wait a while for ``at_most``."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        files = disk.getAllFiles()
        n = sum(files.apply(i).getName().startswith("shuffle") for i in range(files.size()))
        if n <= at_most:
            break
        time.sleep(0.2)
    return n
