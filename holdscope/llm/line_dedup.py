"""Removal of repeated lines, equal or one edit apart, by a deletion-neighbourhood join.

Two lines one edit apart share a hashed variant. If a character was replaced, both lines without it are the same; if one
was inserted, the longer line without it is the shorter line. No pairs are made: among the lines that share a variant
(and, for a replacement, its position) the earliest is enough to tell that the others go.

A line has as many variants as characters, so they are emitted only where a neighbour is possible: cut in the middle, two
lines one edit apart agree in their first or in their second half. A line whose halves no other line shares is done, and
others emit the variants of the half that may differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import ASCII_LOWER, discard, map_batches, materialise, packed_row, shuffle_width, text_bytes

#: Shorter lines are compared for equality alone: an edit makes another word of a short line.
MIN_CHARS = 20
#: Rows of a batch of results.
BATCH_ROWS = 100_000
WHITE = b" \t\r\x0b\x0c"
FACTOR = 0x9E3779B97F4A7C15
FIRST_HALF, SECOND_HALF = 1, 2

LINES = "doc_id bigint, key int, pos int, line bigint, a bigint, b bigint, c bigint, d bigint"
VARIANTS = "variant bigint, deleted int, line bigint, doc_id bigint, key int, pos int"


def normal(line: bytes) -> bytes:
    """What is compared: without white space around it, A-Z made small."""
    return line.strip(WHITE).translate(ASCII_LOWER)


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def half_keys(line: bytes, min_chars: int) -> tuple[int | None, ...]:
    """Hashes of the first and the second half; for odd lengths the middle character counts to either."""
    text = line.decode()
    n = len(text)
    if n < min_chars:
        return (None,) * 4
    digest = xxhash.xxh3_64_intdigest
    halves = (text[: n // 2], text[: (n + 1) // 2], text[(n + 1) // 2 :], text[n // 2 :])
    keys = [signed(digest(h.encode(), seed)) for h, seed in zip(halves, (1, 1, 2, 2), strict=True)]
    return tuple(keys) if n % 2 else (keys[0], None, keys[2], None)


def _find_lines(min_chars: int):
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
    names = [c.split()[0] for c in LINES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            docs = zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True)
            for doc_id, key, text in docs:
                for pos, line in enumerate(text.split(b"\n")):
                    if line := normal(line):
                        rows.append((doc_id, key, pos, signed(xxhash.xxh3_64_intdigest(line)), *half_keys(line, min_chars)))
                    if len(rows) >= BATCH_ROWS:
                        yield _columns(rows, kinds, names)
                        rows = []
            if rows:
                yield _columns(rows, kinds, names)

    return run


def _columns(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """The line's hash, and the hash of the line without each of its characters, in time linear in its length.

    A hash sums mixed characters times powers of a factor, modulo 2**64. What follows the deleted character moves up.
    """
    code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    code = (code * np.uint64(0xBF58476D1CE4E5B9)) ^ (code * np.uint64(0x94D049BB133111EB) >> np.uint64(17))
    powers = np.full(len(code), FACTOR, np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers)
    here = code * powers
    before = np.cumsum(here) - here
    moved = code[1:] * powers[: max(0, len(code) - 1)]
    after = np.zeros(len(code), np.uint64)
    after[: len(moved)] = np.cumsum(moved[::-1])[::-1]
    return int(here.sum()), before + after


def _emit_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their places in; out come their own hashes (deleted -1) and those of their variants."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("line", "halves", "doc_id", "key", "pos", "content")]
        out: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for i, (halves, content) in enumerate(zip(columns[1], columns[5], strict=True)):
            own, variants = variant_hashes(content)
            n = len(content)
            # A shared first half leaves edits in the second, and the other way round.
            low = 0 if halves & SECOND_HALF else n // 2
            high = n if halves & FIRST_HALF else (n + 1) // 2
            out[0].append(np.concatenate([np.array([own], np.uint64), variants[low:high]]))
            out[1].append(np.concatenate([[-1], np.arange(low, high)]))
            out[2].append(np.full(high - low + 1, i))
            size += high - low + 1
            if size >= BATCH_ROWS or i == batch.num_rows - 1:
                of = pa.array(np.concatenate(out[2]))
                kept = [batch.column(c).take(of) for c in ("line", "doc_id", "key", "pos")]
                hashes, deleted = np.concatenate(out[0]).view(np.int64), np.concatenate(out[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(deleted), *kept], [c.split()[0] for c in VARIANTS.split(", ")]
                )
                out, size = [[], [], []], 0


def _join_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole variants in; out come lines that an earlier line shares a variant with, and that line."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    nulls = table.column("doc_id").is_null().to_numpy()
    doc = table.column("doc_id").fill_null(0).to_numpy()
    variant, deleted, line, key, pos = (table.column(c).to_numpy() for c in ("variant", "deleted", "line", "key", "pos"))
    by = np.argsort(variant, kind="stable")
    change = np.flatnonzero(np.diff(variant[by])) + 1
    runs = np.diff(np.concatenate([[0], change, [len(by)]]))
    more = by[np.repeat(runs > 1, runs)]
    nulls, doc, variant, deleted, line, key, pos = (x[more] for x in (nulls, doc, variant, deleted, line, key, pos))
    if not len(more):
        return
    order = np.lexsort((pos, key, doc, nulls))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    losers, winners = [], []
    # A replaced character: equal variants at the same position.
    by = np.lexsort((rank, deleted, variant))
    by = by[deleted[by] >= 0]
    same = np.zeros(len(by), bool)
    same[1:] = (variant[by][1:] == variant[by][:-1]) & (deleted[by][1:] == deleted[by][:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    losers.append(line[by[same]])
    winners.append(line[by[first[same]]])
    # An inserted character: a variant that is a line itself, against the longer lines that have it.
    by = np.lexsort((rank, deleted >= 0, variant))
    edge = np.ones(len(by), bool)
    edge[1:] = variant[by][1:] != variant[by][:-1]
    start = np.maximum.accumulate(np.where(edge, np.arange(len(by)), 0))
    short = by[start]
    grown = (deleted[by] >= 0) & (deleted[short] < 0)
    later = grown & (rank[by] > rank[short])
    losers.append(line[by[later]])
    winners.append(line[short[later]])
    # The earliest longer line comes right after the short one.
    earlier = grown & (np.arange(len(by)) == start + 1) & (rank[by] < rank[short])
    losers.append(line[short[earlier]])
    winners.append(line[by[earlier]])
    loser, winner = np.concatenate(losers), np.concatenate(winners)
    differ = loser != winner
    if differ.any():
        yield pa.RecordBatch.from_arrays([pa.array(loser[differ]), pa.array(winner[differ])], ["loser", "winner"])


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the places of wanted lines in; out come these lines."""
    names = ["line", "halves", "doc_id", "key", "pos", "content"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        docs = zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), text_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True)
        for doc_id, key, text, wanted in docs:
            lines = text.split(b"\n")
            rows += [(w["line"], w["halves"], doc_id, key, w["pos"], normal(lines[w["pos"]]).decode()) for w in wanted]
        if rows:
            yield _columns(rows, kinds, names)


def _keep_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, stay in zip(batch.column("text"), batch.column("stay").to_pylist(), strict=True):
            lines = text.as_py().split("\n") if text.is_valid else []
            places = set(stay or ())
            kept = [x for i, x in enumerate(lines) if i in places or not normal(x.encode())]
            texts.append("\n".join(kept) if text.is_valid else None)
            counts.append(len(lines))
            removed.append(len(lines) - len(kept))
        arrays = [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: each row as a struct, its text without repeated lines, and line counts.

    Lines end at a line feed. They are compared without the white space around them and with A-Z made small. A line
    goes if an earlier one (by id, then place) is equal to it, or is one character edit away (replaced, inserted or
    deleted) and both have at least ``min_chars`` characters. Every line is judged on the input, not on what is left.
    Lines of white space alone stay.

    A null text stays null and has no lines. Null ids come last; rows that share an id but differ in text are
    ordered by a hash of the text; rows that repeat both are one document and each returns its result. An empty table
    gives an empty table. All other columns are in ``row``, so none can clash with a name used here.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.hash(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        packed_row(docs, [c for c in docs.columns if c != text_col]).alias("row"),
    )
    lines = materialise(map_batches(rows.select("doc_id", "key", "text"), _find_lines(min_chars), LINES), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "pos")
    firsts = lines.groupBy("line").agg(F.min(place).alias("at"))

    # Lines that share a half with another line, and which halves.
    stack = F.expr(f"stack(4, a, {FIRST_HALF}, b, {FIRST_HALF}, c, {SECOND_HALF}, d, {SECOND_HALF}) as (half, side)")
    halves = lines.filter("a is not null").select("line", stack).filter("half is not null")
    shared = halves.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).filter("lo <> hi")
    near = halves.join(shared.select("half"), "half", "left_semi").groupBy("line").agg(F.bit_or("side").cast("int").alias("halves"))
    wanted = (
        near.join(firsts, "line")
        .groupBy(F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key"))
        .agg(F.collect_list(F.struct("line", "halves", F.col("at.pos").alias("pos"))).alias("wanted"))
    )
    same = lambda other: rows["doc_id"].eqNullSafe(other["_id"]) & (rows["key"] == other["_key"])
    fetched = map_batches(
        rows.join(wanted, same(wanted)).select("doc_id", "key", "text", "wanted"),
        _lines_of,
        "line bigint, halves int, doc_id bigint, key int, pos int, content string",
    )
    # Rows that repeat id and text bring the same line more than once.
    candidates = materialise(fetched.dropDuplicates(["line"]), "lines")
    variants = map_batches(candidates, _emit_variants, VARIANTS).repartition(width, "variant")
    met = map_batches(variants, _join_variants, "loser bigint, winner bigint").distinct()
    texts = candidates.select("line", "content")
    losers = (
        met.join(texts.select(F.col("line").alias("loser"), F.col("content").alias("x")), "loser")
        .join(texts.select(F.col("line").alias("winner"), F.col("content").alias("y")), "winner")
        .filter(F.levenshtein("x", "y", 1) >= 0)
        .select(F.col("loser").alias("line"))
        .distinct()
    )
    stay = (
        firsts.join(losers, "line", "left_anti")
        .groupBy(F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key"))
        .agg(F.collect_list("at.pos").alias("stay"))
    )
    stay = materialise(stay, "stay")
    discard(lines, candidates)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, n_lines bigint, n_removed bigint"
    return map_batches(rows.join(stay, same(stay), "left").select("text", "stay", "row"), _keep_lines, schema)
