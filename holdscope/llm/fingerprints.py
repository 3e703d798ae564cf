"""Document fingerprints by SimHash, and the search for near ones through permuted block tables.

Everything is DataFrame expressions. Terms are pairs of neighbouring words, weighted by their length, since long
words are rare ones. A term's hash votes on 128 bits; two counters share each sum, so one pass of 64 sums counts
all votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm.common import materialise, packed_row, shuffle_width

BITS = 128
#: Bit 0 and bit 32: a shifted hash gives one vote to each half of a counter.
BOTH = 0x0000000100000001
HALF = 0xFFFFFFFF
WORD_BREAK = "[ \\t\\n\\x0B\\f\\r]+"


def terms(text: Column) -> Column:
    """Pairs of neighbouring words; the last word stands alone, and a text without words is one empty word."""
    words = F.split(F.lower(text), WORD_BREAK)
    return F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))


def with_term(df: DataFrame, text: str) -> DataFrame:
    """One row per term of ``text``, with its two hashes and its weight; the text itself goes."""
    pair = df.withColumn("_term", F.explode(terms(F.col(text)))).drop(text)
    first, second = F.col("_term.a"), F.col("_term.b")
    return (
        pair.withColumn("_w", (F.length(first) + F.coalesce(F.length(second), F.lit(0)) + 1).cast("bigint"))
        .withColumn("_h0", F.xxhash64(first, second))
        .drop("_term")
        .withColumn("_h1", F.xxhash64("_h0"))
    )


def votes() -> list[Column]:
    """Sums of the weights by bit, two bits to a sum, and the sum of all weights.

    A text has fewer than 2**31 characters and each lies in two terms at most, so a counter fits 32 bits.
    """
    counters = [
        F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(BOTH)) * F.col("_w")).alias(f"{h}_{i}")
        for h in ("_h0", "_h1")
        for i in range(32)
    ]
    return [*counters, F.sum("_w").alias("_total")]


def majority() -> list[Column]:
    """The fingerprint's two halves as bigints: bits that got more than half of all weight."""

    def bit(counter: Column, at: int) -> Column:
        return F.when(2 * counter > F.col("_total"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0))

    halves = []
    for h in ("_h0", "_h1"):
        low = [bit(F.col(f"{h}_{i}").bitwiseAND(F.lit(HALF)), i) for i in range(32)]
        high = [bit(F.shiftrightunsigned(f"{h}_{i}", 32), i + 32) for i in range(32)]
        whole = low[0]
        for b in low[1:] + high:
            whole = whole.bitwiseOR(b)
        halves.append(whole)
    return halves


def in_hex(first: Column, second: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def differing(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(bits: Column) -> Column:
    """Estimate of the cosine of two texts' weighted terms from their differing bits: 1 if none, 0 from half on."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / BITS) * bits))


def next_texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(bucket, place, text, next)``: texts in descending order of ids with the text after, and ``(bucket, place, row)``.

    Rows are dealt to buckets by quantiles of the id, and a window looks ahead in each; the last row of a bucket takes
    the first text of the next bucket that has rows, and the last of all the very first. The other columns are placed
    on their own, so that all that is made of the texts shares one shuffle of them.
    """
    spark = docs.sparkSession
    buckets = 4 * shuffle_width(spark)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        packed_row(docs, [c for c in docs.columns if c != text_col]).alias("row"),
    ).withColumn("key", F.xxhash64("text"))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.select(F.percentile_approx("id", shares, 100 * buckets).alias("cuts")).first()
    cuts = sorted(set(found["cuts"] or []))
    # Larger ids come first. Null ids come last and are spread by their texts' hashes.
    above = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= F.col("id")))
    spread = len(cuts) + 1 + F.floor((F.shiftright("key", 32) + (1 << 31)) * buckets / (1 << 32)).cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), spread).otherwise(above).cast("int"))
    order = [F.desc_nulls_last("id"), F.asc("key")]
    inside = Window.partitionBy("bucket").orderBy(*order)
    place = F.row_number().over(inside)
    placed = rows.drop("row").withColumn("place", place).withColumn("after", F.lead("text").over(inside))
    others = rows.drop("text").withColumn("place", place).select("bucket", "place", "row")
    # The first text of each bucket: as many rows as there are buckets.
    heads = rows.groupBy("bucket").agg(
        F.min(F.struct(F.col("id").isNull().alias("n"), (-F.col("id")).alias("m"), "key")).alias("least")
    )
    at = (rows["id"].eqNullSafe(-F.col("least.m"))) & (rows["key"] == F.col("least.key"))
    first = (
        rows.join(F.broadcast(heads.select("bucket", "least").withColumnRenamed("bucket", "_bucket")), at & (F.col("bucket") == F.col("_bucket")))
        .select("bucket", "text")
        .dropDuplicates(["bucket"])
    )
    every = Window.orderBy("bucket")
    around = first.select(
        F.col("bucket").alias("_bucket"),
        F.coalesce(
            F.lead("text").over(every),
            F.first("text").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("_head"),
    )
    met = placed.join(around, F.col("bucket") == F.col("_bucket"))
    return met.select("bucket", "place", "text", F.coalesce("after", "_head").alias("next")), others


def edited(text: Column, other: Column) -> Column:
    """The last third of a text replaced by as many characters from the beginning of another (or all of it)."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(other, F.lit(1), cut))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, n_chars, edited_sha256, f0, f1, e0, e1, n0, n1)``: fingerprints of a text, its edit and the next text.

    A fingerprint is two bigints of 64 bits. The next row is the one with the next smaller id; after the last comes the
    first, so a table of one row is its own next. Null ids come last; rows that share an id are ordered by a hash of the
    text, and repeated rows each return. A null text is empty. A text without words has the fingerprint of one empty
    word. An empty table gives an empty table. All columns but the text are in ``row``, so none can clash.
    """
    follow, others = next_texts(docs, id_col, text_col)
    change = edited(F.col("text"), F.col("next"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), change.alias("text"))
    )
    prints = (
        with_term(
            follow.select("bucket", "place", F.explode(kinds).alias("_k")).select("bucket", "place", "_k.kind", "_k.text"), "text"
        )
        .groupBy("bucket", "place", "kind")
        .agg(*votes())
    )
    f0, f1 = majority()
    prints = prints.select("bucket", "place", "kind", f0.alias("f0"), f1.alias("f1"))
    prints = prints.groupBy("bucket", "place").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(n) for k, c, n in ((0, "f0", "f0"), (0, "f1", "f1"), (1, "f0", "e0"), (1, "f1", "e1"))]
    )
    facts = follow.select(
        "bucket", "place", F.length("text").cast("bigint").alias("n_chars"), F.sha2(change, 256).alias("edited_sha256")
    )
    known = materialise(others.join(facts, ["bucket", "place"]).join(prints, ["bucket", "place"]), "fingerprints")
    # The next fingerprint: again ahead in the bucket, or the first one of the next bucket.
    inside = Window.partitionBy("bucket").orderBy("place")
    every = Window.orderBy("bucket")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pair = F.struct("f0", "f1")
    around = (
        known.filter("place = 1")
        .select("bucket", pair.alias("f"))
        .select(
            F.col("bucket").alias("_bucket"),
            F.coalesce(F.lead("f").over(every), F.first("f").over(whole)).alias("_head"),
        )
    )
    after = F.coalesce("_after", "_head")
    return (
        known.withColumn("_after", F.lead(pair).over(inside))
        .join(around, F.col("bucket") == F.col("_bucket"))
        .select("row", "n_chars", "edited_sha256", "f0", "f1", "e0", "e1", after["f0"].alias("n0"), after["f1"].alias("n1"))
    )


def blocks(first: Column, second: Column, radius: int) -> list[Column]:
    """The bits cut into ``radius + 1`` blocks; fingerprints within the radius agree on one at least."""
    edges = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        parts = []
        for half, begin in ((first, 0), (second, 64)):
            low, high = max(a, begin) - begin, min(b, begin + 64) - begin
            if low < high:
                mask = (1 << (high - low)) - 1
                parts.append(F.shiftrightunsigned(half, low).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
        out.append(F.xxhash64(*parts) if len(parts) > 1 else parts[0])
    return out


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """``(q0, q1, f0, f1, bits)``: all distinct fingerprints within ``radius`` bits of each distinct query.

    Both sides have bigint columns ``f0`` and ``f1``. Each fingerprint lies in one table per block, keyed by that
    block; a pair is taken from the first table in which it meets. Radius 0 to 31. Rows with a null half match nothing.
    """

    def tables(df: DataFrame) -> DataFrame:
        df = df.select("f0", "f1").dropna().distinct()
        keyed = F.array(*blocks(F.col("f0"), F.col("f1"), radius))
        return df.select("f0", "f1", keyed.alias("keys")).select("f0", "f1", "keys", F.posexplode("keys").alias("table", "block"))

    q = tables(queries).select("table", "block", *[F.col(c).alias(n) for c, n in (("f0", "q0"), ("f1", "q1"), ("keys", "q_keys"))])
    met = q.join(tables(prints), ["table", "block"])
    bits = differing((F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1")))
    same = F.transform(F.arrays_zip("keys", "q_keys"), lambda p: p["keys"] == p["q_keys"])
    first = F.array_position(same, True) == F.col("table") + 1
    return met.filter((bits <= radius) & first).select("q0", "q1", "f0", "f1", bits.alias("bits"))
