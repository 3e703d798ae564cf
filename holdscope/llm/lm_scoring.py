"""Language-model scores from a log-frequency Bloom filter.

Training counts n-grams by hash. A count is quantised to a level of a logarithmic scale, and the filter holds the pairs
(n-gram, 1) to (n-gram, level). Levels are read back by probing 1, 2, ... until a probe fails. Probabilities are
smoothed with a Dirichlet prior from the next shorter history.

The filter is cut by hash range into parts, and parts are gathered into shards of bounded size. A shard is broadcast;
with several shards, each reads the texts once and the levels are put together by document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import (
    ASCII_LOWER,
    key_of,
    map_batches,
    map_groups,
    materialise,
    ragged_ranges,
    shuffle_width,
    text_bytes,
)

ORDER = 2
#: Each level of the scale is this many times the one before, and at least one more.
BASE = 1.1
LEVELS = 255
BITS_PER_ITEM = 8
PROBES = 4
#: Weight of the shorter history, in counts.
PRIOR = 500.0
#: Bytes of filter and vocabulary that are broadcast at a time.
SHARD_BYTES = 192 << 20
#: Bytes of text for each part of the filter, so that a part's counts fit a task however much there is to count.
PART_BYTES = 12 << 20
#: Tokens that a task counts before it passes the counts on, and bytes of text hashed at a time.
COUNTED_TOKENS = 2_000_000
BLOCK = 1 << 20

U = np.uint64
FACTOR = 0x9E3779B97F4A7C15
END = U(0xD6E8FEB86659FD93)
LONG_TOKEN = 4096
POWERS = np.cumprod(np.full(LONG_TOKEN, FACTOR, U))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scale() -> np.ndarray:
    """Least count of each level."""
    least = [1]
    while len(least) < LEVELS:
        least.append(max(least[-1] + 1, int(np.ceil(least[-1] * BASE))))
    return np.array(least, np.int64)


SCALE = scale()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def token_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, an end token after each text, and the number per text."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    joined = (b" ".join(texts) + b" ").translate(ASCII_LOWER)
    data = np.frombuffer(joined, np.uint8)
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = stops - starts
    hashes = np.empty(0, U)
    if len(starts):
        place = np.minimum(ragged_ranges(np.zeros(len(starts)), lengths), LONG_TOKEN - 1)
        parts = (data[inside].astype(U) + U(1)) * POWERS[place]
        hashes = np.add.reduceat(parts, np.cumsum(lengths) - lengths)
        for i in np.flatnonzero(lengths > LONG_TOKEN):
            hashes[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : stops[i]])
    text = np.searchsorted(np.cumsum(sizes), starts, side="right")
    counts = np.bincount(text, minlength=len(texts)).astype(np.int64)
    out = np.full(len(starts) + len(texts), END, U)
    out[np.arange(len(starts)) + text] = mixed(hashes)
    return out, counts + 1


def gram_hashes(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """For 1 to ``order``, the hash of the run of so many tokens that ends at each token. End tokens precede a text."""
    first = np.cumsum(counts) - counts
    place = ragged_ranges(np.zeros(len(counts)), counts)
    begin = np.repeat(first, counts)
    grams = [tokens]
    for n in range(1, order):
        before = np.maximum(np.arange(len(tokens)) - n, 0)
        earlier = np.where(place >= n, tokens[np.maximum(before, begin)], END)
        grams.append(mixed(grams[-1] * U(FACTOR) + earlier + U(n)))
    return grams


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(parts)) >> U(32)


LOW = U(0xFFFFFFFF)


def probed(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and stride, of 32 bits, of the probes for the pairs (n-gram, level)."""
    h = mixed(hashes + U(FACTOR * (level + 1) % (1 << 64)))
    return h & LOW, (h >> U(32)) | U(1)


def place(first: np.ndarray, stride: np.ndarray, probe: int, bits: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of one probe in a filter of so many bits, fewer than 2^32."""
    at = (((first + U(probe) * stride) & LOW) * bits) >> U(32)
    return (at >> U(3)).astype(np.int64), (at & U(7)).astype(np.uint8)


def build_filter(hashes: np.ndarray, levels: np.ndarray, bits_per_item: int) -> np.ndarray:
    """A Bloom filter, as bytes, of the pairs (hash, 1) to (hash, level)."""
    filled = np.zeros(max(8, int(levels.sum()) * bits_per_item // 8 + 1), np.uint8)
    if 8 * len(filled) >= 1 << 32:
        raise ValueError("a part's filter has 2^32 bits or more; take more parts")
    level = 1
    while len(hashes):
        first, stride = probed(hashes, level)
        for probe in range(PROBES):
            byte, bit = place(first, stride, probe, U(8 * len(filled)))
            np.bitwise_or.at(filled, byte, np.left_shift(np.uint8(1), bit))
        more = levels > level
        hashes, levels, level = hashes[more], levels[more], level + 1
    return filled


@dataclass
class Shard:
    """Neighbouring parts: their filters end to end, and the exact counts of their tokens."""

    parts: int
    first: int
    filled: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    counts: np.ndarray

    def mine(self, hashes: np.ndarray) -> np.ndarray:
        part = part_of(hashes, self.parts)
        return (part >= U(self.first)) & (part < U(self.first + len(self.sizes)))

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash, probed from 1 on until a pair is not in its part's filter; zero for other shards'."""
        out = np.zeros(len(hashes), np.uint8)
        alive = np.flatnonzero(self.mine(hashes))
        hashes = hashes[alive]
        part = part_of(hashes, self.parts).astype(np.int64) - self.first
        begin, bits = (np.cumsum(self.sizes) - self.sizes)[part], (8 * self.sizes).astype(U)[part]
        level = 1
        while len(alive) and level <= LEVELS:
            first, stride = probed(hashes, level)
            held = np.arange(len(alive))
            for probe in range(PROBES):
                byte, bit = place(first[held], stride[held], probe, bits[held])
                held = held[(self.filled[begin[held] + byte] >> bit) & np.uint8(1) == 1]
            alive, hashes, begin, bits = alive[held], hashes[held], begin[held], bits[held]
            out[alive] = level
            level += 1
        return out

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, self.counts[at], 0).astype(np.int64)


@dataclass
class Totals:
    tokens: int
    distinct: int
    quantised: float


def _counted(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in range(order)]

        def flush() -> pa.RecordBatch:
            rows: list[list] = [[], [], [], []]
            for n, found in enumerate(kept):
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                edges = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
                for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if a < b:
                        packed = (p, n, hashes[a:b].tobytes(), counts[a:b].astype("<u4").tobytes())
                        for column, value in zip(rows, packed, strict=True):
                            column.append(value)
                found.clear()
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["part", "n", "hashes", "counts"])

        size = 0
        for batch in batches:
            for _, tokens, counts in _blocks(batch):
                for found, grams in zip(kept, gram_hashes(tokens, counts, order), strict=True):
                    found.append(grams)
                size += len(tokens)
                if size >= COUNTED_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a batch in blocks of bounded text, with their token hashes and token numbers."""
    block, begin, size = [], 0, 0
    for i, text in enumerate(text_bytes(batch.column("text"))):
        block.append(text)
        size += len(text)
        if size >= BLOCK or i == batch.num_rows - 1:
            yield slice(begin, i + 1), *token_hashes(block)
            block, begin, size = [], i + 1, 0


def _part_filter(bits_per_item: int):
    """All counts of a part in; its filter, vocabulary and totals out."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("n").to_numpy()
        hashes, counts = (table.column(c).to_pylist() for c in ("hashes", "counts"))
        found = {}
        for n in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == n)
            h = np.frombuffer(b"".join([hashes[i] for i in rows]), U)
            c = np.frombuffer(b"".join([counts[i] for i in rows]), "<u4").astype(np.int64)
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            found[n] = h[first], np.add.reduceat(c, first)
        level = {n: np.searchsorted(SCALE, c, side="right") for n, (_, c) in found.items()}
        filled = build_filter(
            np.concatenate([h for h, _ in found.values()]), np.concatenate(list(level.values())), bits_per_item
        )
        words, exact = found.get(0, (np.empty(0, U), np.empty(0, np.int64)))
        quantised = float(SCALE[level[0] - 1].sum()) if len(words) else 0.0
        return pa.table(
            {
                "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                "filter": pa.array([filled.tobytes()], pa.binary()),
                "vocabulary": pa.array([words.tobytes()], pa.binary()),
                "counts": pa.array([exact.astype("<i8").tobytes()], pa.binary()),
                "tokens": pa.array([int(exact.sum())], pa.int64()),
                "distinct": pa.array([len(words)], pa.int64()),
                "quantised": pa.array([quantised], pa.float64()),
                "bytes": pa.array([len(filled) + 12 * len(words)], pa.int64()),
            }
        )

    schema = "part int, filter binary, vocabulary binary, counts binary, tokens bigint, distinct bigint, quantised double, bytes bigint"
    return run, schema


def fit(docs: DataFrame, text_col: str, order: int, bits_per_item: int, parts: int) -> tuple[DataFrame, Totals]:
    """The filter by part, written to the shared folder, and the totals of the training tokens."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = map_batches(texts, _counted(order, parts), "part int, n int, hashes binary, counts binary")
    model = materialise(map_groups(counted, ["part"], *_part_filter(bits_per_item)), "filter")
    row = model.agg(F.sum("tokens"), F.sum("distinct"), F.sum("quantised")).first()
    return model, Totals(row[0] or 0, row[1] or 0, row[2] or 0.0)


def shards(model: DataFrame, parts: int, shard_bytes: int) -> Iterator[Shard]:
    """Neighbouring parts, as many as the bound allows, one shard after the other."""
    sizes = dict(model.select("part", "bytes").collect())
    groups: list[list[int]] = [[]]
    room = shard_bytes
    for p in range(parts):
        if groups[-1] and sizes.get(p, 0) > room:
            groups.append([])
            room = shard_bytes
        groups[-1].append(p)
        room -= sizes.get(p, 0)
    for group in groups:
        found: dict[str, list] = {"filter": [bytes(8)] * len(group), "vocabulary": [], "counts": []}
        wanted = model.filter(F.col("part").between(group[0], group[-1])).orderBy("part")
        for r in wanted.select("part", "filter", "vocabulary", "counts").toLocalIterator():
            found["filter"][r["part"] - group[0]] = bytes(r["filter"])
            found["vocabulary"].append(bytes(r["vocabulary"]))
            found["counts"].append(bytes(r["counts"]))
        counts = np.frombuffer(b"".join(found["counts"]), "<i8")
        yield Shard(
            parts,
            group[0],
            np.frombuffer(b"".join(found["filter"]), np.uint8),
            np.array([len(f) for f in found["filter"]], np.int64),
            np.frombuffer(b"".join(found["vocabulary"]), U),
            counts.astype("<u4") if counts.max(initial=0) < 1 << 32 else counts,
        )


def probabilities(levels: np.ndarray, counts: np.ndarray, totals: Totals, prior: float) -> np.ndarray:
    """log10 probability of every token from the levels (order, tokens) of the runs that end there.

    With one token, p(w) = (c(w) + 1) / (C + V + 1), where C sums the quantised counts. With a history h and h' the
    shorter one, p(w | h) = (c(hw) + prior * p(w | h')) / (c(h) + prior). Counts of runs are the least of their level,
    those of histories the greatest, so no history gives out more than one.
    """
    least = np.concatenate([[0], SCALE]).astype(np.float64)
    most = np.concatenate([[0], SCALE[1:] - 1, [SCALE[-1]]]).astype(np.float64)
    p = (least[levels[0]] + 1) / (totals.quantised + totals.distinct + 1)
    first = np.zeros(levels.shape[1], bool)
    first[np.cumsum(counts) - counts] = True
    ends = np.repeat(levels[0][np.cumsum(counts) - 1], counts) if len(counts) else levels[0]
    for n in range(1, len(levels)):
        history = np.roll(levels[n - 1], 1)
        # Before a text stand end tokens; a history of one end token has the end token's count, a longer one is
        # the run that ends before the first token, which no text holds: its count is that of the end token too.
        history[first] = ends[first]
        p = (least[levels[n]] + prior * p) / (most[history] + prior)
    return np.log10(p)


def _read_levels(shared, order: int, totals: Totals):
    """Levels, and the exact counts' part of the figures, for what belongs to a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard = shared.value
        floor = totals.tokens + totals.distinct + 1
        for batch in batches:
            for rows, tokens, counts in _blocks(batch):
                distinct, where = np.unique(tokens, return_inverse=True)
                mine = shard.mine(distinct)
                exact = shard.exact(distinct)
                levels = [shard.levels(distinct)[where]]
                for grams in gram_hashes(tokens, counts, order)[1:]:
                    # A run that repeats in the block is probed once.
                    runs, at = np.unique(grams, return_inverse=True)
                    levels.append(shard.levels(runs)[at])
                levels = np.stack(levels)
                first = np.cumsum(counts) - counts
                base = np.add.reduceat(np.where(mine, np.log10((exact + 1) / floor), 0.0)[where], first)
                known = np.add.reduceat((exact > 0).astype(np.int64)[where], first)
                parts = [levels[:, a : a + n].tobytes() for a, n in zip(first.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[rows.start : rows.stop],
                        batch.column("key")[rows.start : rows.stop],
                        pa.array(counts),
                        pa.array(known),
                        pa.array(base),
                        pa.array(parts, pa.binary()),
                    ],
                    ["doc_id", "key", "n_tokens", "n_known", "base_score", "levels"],
                )

    return run


def _score_levels(order: int, totals: Totals, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for found in batch.column("levels").to_pylist():
                levels = np.frombuffer(found[0], np.uint8).copy()
                for other in found[1:]:
                    np.maximum(levels, np.frombuffer(other, np.uint8), out=levels)
                levels = levels.reshape(order, -1)
                scores.append(float(probabilities(levels, np.array([levels.shape[1]]), totals, prior).sum()))
            kept = [batch.column(c) for c in ("doc_id", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


READ = "doc_id bigint, key bigint, n_tokens bigint, n_known bigint, base_score double, levels binary"
SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def score(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    bits_per_item: int = BITS_PER_ITEM,
    prior: float = PRIOR,
    shard_bytes: int = SHARD_BYTES,
    parts: int | None = None,
) -> tuple[DataFrame, Totals]:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every row, and the totals of the training tokens.

    The model counts the texts of rows where ``learns`` is true, all of them and whole. Tokens are the words between
    ASCII white space with A-Z made small, then one end token. ``n_known`` counts tokens that the training texts hold,
    ``base_score`` adds up log10 of (count + 1) / (tokens + distinct + 1) with exact counts, ``score`` is the model's
    log10 probability of the text.

    A null text is empty: the end token alone. A null id stays null. Repeated rows each count and each return. An empty
    table, or none to learn from, gives counts of zero. Other columns are ignored. The filter errs by telling a level
    too high, with a chance of about 2 % at 8 bits an item; counts beyond the scale's last level read as that level.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        parts = max(16, shuffle_width(spark), -(-size // PART_BYTES))
    model, totals = fit(docs.filter(F.coalesce(learns, F.lit(False))), text_col, order, bits_per_item, parts)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        key_of(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    read = None
    several = 0
    for shard in shards(model, parts, shard_bytes):
        shared = spark.sparkContext.broadcast(shard)
        one = map_batches(rows, _read_levels(shared, order, totals), READ)
        several += 1
        read = one if read is None else read.unionByName(one)
    if several == 1:
        together = read.withColumn("levels", F.array("levels"))
    else:
        together = (
            read.groupBy("doc_id", "key")
            .agg(
                F.first("n_tokens").alias("n_tokens"),
                F.sum("n_known").alias("n_known"),
                F.sum("base_score").alias("base_score"),
                F.collect_list("levels").alias("levels"),
            )
            .withColumn("copies", F.expr(f"cast(size(levels) div {several} as int)"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .withColumn("n_known", F.expr("n_known div copies"))
            .withColumn("base_score", F.col("base_score") / F.col("copies"))
            .drop("copy", "copies", "key")
        )
    scored = map_batches(together.select("doc_id", "n_tokens", "n_known", "base_score", "levels"), _score_levels(order, totals, prior), SCORED)
    return scored, totals
