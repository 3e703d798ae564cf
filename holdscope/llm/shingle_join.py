"""Near-copy documents by SimHash, completed by an exact join of their shingle sets.

Each set has a SimHash fingerprint. The trie of the fingerprints is walked as by ``simhash_trie`` and proposes links of all that
lie within three bits; bands of sampled bits propose pairs that differ in some more. The pairs are compared member by member;
this links most near copies. A fifth of all members may differ, which no bound on 64 bits covers, so what is not linked yet
goes through an exact join.

Two sets of Jaccard similarity 0.8 or more share a member among the first fifth of both, in whatever order all sets are
put (prefix filter). Of sets that meet there the members are counted by hash bucket first: the sum of the lesser counts
bounds what they share. Only pairs that this leaves open are compared member by member, so no near copy is missed and none
is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.llm import simhash_trie
from holdscope.llm.common import (
    discard,
    in_bitmap,
    key_bitmap,
    key_of,
    map_batches,
    materialise,
    packed_row,
    ragged_ranges,
    shuffle_width,
    text_bytes,
)
from holdscope.llm.components import components
from holdscope.llm.simhash_trie import BITS, majority_bits, shingle_hashes

WORDS = 5
#: Shared members of near copies: at least LEAST[0] / LEAST[1] of all members of both.
LEAST = (4, 5)
#: One in so many documents is looked at for common shingles; these come last in the order of a set.
LOOKED_AT = 16
COMMON_DOCS = 3
COMMON_ROWS = 1_000_000
#: Rows of a batch that a worker gives back.
BATCH_ROWS = 100_000
#: Pairs that a task holds before it drops those that it has twice.
BLOCK_PAIRS = 1 << 21
#: Hash buckets in which the members of a set are counted; a full count bounds nothing.
BUCKETS, FULL = 256, 255
#: Buckets of the coarse counts that pairs under a token are held against before they leave the task.
COARSE = 64
#: Rows of a token that are compared in one task; more are cut into blocks that meet in pairs.
TOKEN_ROWS = 4096
#: Rows that a task gets at a time, about.
TASK_ROWS = 400_000

#: Fingerprints that differ in so many bits are all linked by the walk of the trie.
TRIE_BITS = 3
#: Samples of the fingerprint's bits under which sets meet.
BANDS = 32
#: Pairs whose fingerprints differ in more bits are not compared: at 0.8 about ten differ, hardly ever more than these.
MOST_BITS = 20

MET = "token bigint, doc bigint, size int, pos int"


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(shingle_hashes(text, words)).view(np.int64)


def set_name(shingles: np.ndarray) -> int:
    """Texts with the same shingles share it."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def prefix_length(size: int) -> int:
    """So many first members of a set: a near copy has one of them among its own first members."""
    return size - -(-size * LEAST[0] // LEAST[1]) + 1 if size else 0


def may_be_near(size_a, pos_a, size_b, pos_b):
    """Whether sets that first meet at these positions can still share enough; arrays or columns."""
    low, high = LEAST
    of = np.minimum if isinstance(size_a, np.ndarray) else F.least
    return of(size_a - pos_a, size_b - pos_b) * (low + high) >= (size_a + size_b) * low


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Shingles of several documents among those looked at. They only decide the order, never the result."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words))], ["token"])

    found = map_batches(texts.filter(F.pmod("key", F.lit(LOOKED_AT)) == 0).select("text"), of, "token bigint")
    counted = found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_DOCS)
    rows = counted.orderBy(F.desc("n"), "token").limit(COMMON_ROWS).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy())


def bucket_counts(shingles: np.ndarray) -> bytes:
    """Members by hash bucket, one byte each."""
    return np.minimum(np.bincount(shingles.view(np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS), FULL).astype(np.uint8).tobytes()


def coarse_counts(buckets: bytes) -> bytes:
    """Neighbouring buckets taken together."""
    counts = np.frombuffer(buckets, np.uint8).reshape(COARSE, -1).astype(np.int64)
    return np.where((counts == FULL).any(axis=1), FULL, np.minimum(counts.sum(axis=1), FULL)).astype(np.uint8).tobytes()


def may_share(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sets of these bucket counts and sizes can share enough."""
    low, high = LEAST
    shared = np.minimum(a, b)
    most = np.where((shared == FULL).any(axis=1), np.minimum(size_a, size_b), shared.sum(axis=1, dtype=np.int64))
    return most * (low + high) >= (size_a + size_b) * low


FACTS = "doc_id bigint, key bigint, doc bigint, size int, buckets binary, coarse binary, prefix array<bigint>, fingerprint bigint"


def _facts(common, words: int):
    """Texts in; out come the name and size of each set, its bucket counts, its first members and its fingerprint.

    Of sets that repeat within a batch only one has the last four.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            names, sizes, buckets, coarse, prefixes, prints, seen = [], [], [], [], [], [], set()
            for text in text_bytes(batch.column("text")):
                tokens = shingle_set(text, words)
                names.append(set_name(tokens))
                sizes.append(len(tokens))
                if not len(tokens) or names[-1] in seen:
                    buckets.append(None)
                    coarse.append(None)
                    prefixes.append(None)
                    prints.append(None)
                    continue
                seen.add(names[-1])
                buckets.append(bucket_counts(tokens))
                coarse.append(coarse_counts(buckets[-1]))
                prints.append(as_signed(majority_bits(tokens.view(np.uint64))))
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    often = known[at] == tokens
                    tokens = np.concatenate([tokens[~often], tokens[often]])
                prefixes.append(tokens[: prefix_length(len(tokens))])
            found = [pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(buckets, pa.binary())]
            found += [pa.array(coarse, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *found], [c.split()[0] for c in FACTS.split(", ")])

    return run


def as_signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def band_masks(sets: int) -> list[int]:
    """The bits of each band: about as many as leave a chance set alone in its bucket, whatever the number of sets."""
    width = min(BITS // 2, max(8, sets.bit_length()))
    rng = np.random.default_rng(42)
    return [as_signed(sum(1 << int(b) for b in rng.choice(BITS, width, replace=False))) for _ in range(BANDS)]


def trie_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of set names that connect all whose fingerprints reach each other in steps of ``TRIE_BITS`` bits.

    The walk links distinct fingerprints, each named by its least set; the other sets of a fingerprint are tied to that one.
    """
    least = prints.groupBy("fingerprint").agg(F.min("doc").alias("least"))
    links = simhash_trie.near_links(least.select("fingerprint"), TRIE_BITS)
    of = lambda name: least.select(F.col("fingerprint").alias(name), F.col("least").alias(f"doc_{name}"))
    walked = links.join(of("u"), "u").join(of("v"), "v").select(F.col("doc_u").alias("a"), F.col("doc_v").alias("b"))
    same = prints.join(least, "fingerprint").filter("doc <> least").select(F.col("least").alias("a"), F.col("doc").alias("b"))
    return walked.unionByName(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def band_pairs(prints: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of set names whose fingerprints agree in all bits of a band and are neighbours there.

    Sets that agree in all bits of a band lie in one bucket, in the order of their fingerprints; neighbours there are a
    pair if few bits differ in all. A bucket of n sets gives n - 1 pairs, so a large group costs no more than others.
    """
    masks = band_masks(prints.count())
    each = [F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    banded = prints.select("doc", "fingerprint", F.explode(F.array(*each)).alias("b"))
    bucket = Window.partitionBy("b.band", "b.bits").orderBy("fingerprint", "doc")
    beside = banded.select("doc", "fingerprint", *[F.lag(c).over(bucket).alias(f"{c}_before") for c in ("doc", "fingerprint")])
    near = beside.filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("fingerprint_before"))) <= MOST_BITS)
    return near.select(F.least("doc", "doc_before").alias("u"), F.greatest("doc", "doc_before").alias("v"))


def fingerprint_pairs(facts: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of set names that SimHash proposes, by the trie and by bands of bits; written."""
    prints = facts.filter("fingerprint is not null").groupBy("doc").agg(F.min("fingerprint").alias("fingerprint"))
    prints = materialise(prints, "prints")
    proposed = materialise(trie_pairs(prints).unionByName(band_pairs(prints)).distinct(), "proposed")
    discard(prints)
    return proposed


def _runs(values: np.ndarray) -> np.ndarray:
    """Lengths of the runs of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    return np.diff(np.concatenate([[0], edges, [len(values)]]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of token and doc; out come those of tokens that several sets have, each set once.

    Only the last row is carried from batch to batch, and whether its token has been passed on.
    """
    names = [c.split()[0] for c in MET.split(", ")]
    held: list | None = None
    passed = False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            columns = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held, columns, strict=True)]
        token, doc = columns[:2]
        new = np.ones(len(token), bool)
        new[1:] = (np.diff(token) != 0) | (np.diff(doc) != 0)
        columns = [c[new] for c in columns]
        runs = _runs(columns[0])
        several = runs > 1
        several[0] |= passed
        keep = np.repeat(several, runs)
        # The carried row went out before if its token did.
        keep[0] &= not passed
        last = bool(several[-1])
        out = [c[keep] for c in columns]
        for at in range(0, len(out[0]), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH_ROWS]) for c in out], names)
        held, passed = [c[-1] for c in columns], last


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole cells with their groups in; out come the pairs of different groups that may be near.

    A cell is a token, or two blocks of a token that has very many rows, whose rows meet across the blocks only.
    """
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    token, doc, size, pos, group, block = (table.column(c).to_numpy() for c in ("cell", "doc", "size", "pos", "group", "block"))
    by = np.lexsort((group, token))
    token, doc, group, block = token[by], doc[by], group[by], block[by]
    size, pos = size[by].astype(np.int64), pos[by].astype(np.int64)
    same_token = _runs(token)
    end = np.repeat(np.cumsum(same_token), same_token)
    new = np.ones(len(token), bool)
    new[1:] = (np.diff(token) != 0) | (np.diff(group) != 0)
    lengths = np.diff(np.append(np.flatnonzero(new), len(token)))
    # A row meets what follows its group under the same token.
    begin = np.repeat(np.cumsum(lengths), lengths)
    count = end - begin
    # Pairs are held as places among the distinct docs, each once.
    docs, first, at = np.unique(doc, return_index=True, return_inverse=True)
    counts = np.frombuffer(b"".join(table.column("coarse").take(pa.array(by[first])).to_pylist()), np.uint8).reshape(-1, COARSE)
    sizes = size[first]
    held: list[np.ndarray] = []
    i = 0
    while i < len(token):
        j = max(i + 1, int(np.searchsorted(np.cumsum(count[i:]), BLOCK_PAIRS)) + i)
        a = np.repeat(np.arange(i, j), count[i:j])
        b = ragged_ranges(begin[i:j], count[i:j])
        near = may_be_near(size[a], pos[a], size[b], pos[b]) & ((block[a] != block[b]) | (block[a] < 0))
        a, b = at[a[near]], at[b[near]]
        held.append(np.unique(np.minimum(a, b) * len(docs) + np.maximum(a, b)))
        if sum(map(len, held)) >= BLOCK_PAIRS or j == len(token):
            pairs = np.unique(np.concatenate(held))
            held = []
            for k in range(0, len(pairs), BATCH_ROWS):
                a, b = np.divmod(pairs[k : k + BATCH_ROWS], len(docs))
                stay = may_share(counts[a], counts[b], sizes[a], sizes[b])
                yield pa.RecordBatch.from_arrays([pa.array(docs[a[stay]]), pa.array(docs[b[stay]])], ["u", "v"])
        i = j


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bucket counts let them share enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("of_u", "of_v"))
        stay = may_share(a, b, *(batch.column(c).to_numpy().astype(np.int64) for c in ("size_u", "size_v")))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(stay)) for c in ("u", "v")], ["u", "v"])


def _near(pairs: DataFrame, texts: DataFrame, facts: DataFrame, words: int) -> DataFrame:
    """The pairs whose sets share enough, by all of their members; written, so nothing else is needed any more."""
    spark = pairs.sparkSession
    either = lambda p: p.select(F.col("u").alias("doc")).unionByName(p.select(F.col("v").alias("doc"))).distinct()
    told = facts.filter("buckets is not null").join(either(pairs), "doc", "left_semi")
    told = told.groupBy("doc").agg(F.min(F.struct("key", "buckets")).alias("f"), F.min("size").alias("size"))
    told = materialise(told.select("doc", "f.key", "f.buckets", "size"), "told")
    of = lambda name: told.select(F.col("doc").alias(name), F.col("buckets").alias(f"of_{name}"), F.col("size").alias(f"size_{name}"))
    maybe = materialise(map_batches(pairs.join(of("u"), "u").join(of("v"), "v"), _open, "u bigint, v bigint"), "maybe")
    wanted = spark.sparkContext.broadcast(key_bitmap(told.join(either(maybe), "doc", "left_semi").select("key")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(in_bitmap(wanted.value, batch.column("key").to_numpy())))
            for text in text_bytes(rows.column("text")):
                found = shingle_set(text, words)
                arrays = [pa.array([set_name(found)], pa.int64()), pa.array([found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "members"])

    sets = map_batches(texts.select("key", "text"), members, "doc bigint, members array<bigint>")
    sets = materialise(sets.join(either(maybe), "doc", "left_semi").dropDuplicates(["doc"]), "sets")
    side = lambda name: sets.select(F.col("doc").alias(name), F.col("members").alias(f"of_{name}"))
    shared = F.size(F.array_intersect("of_u", "of_v"))
    low, high = LEAST
    enough = shared * high >= (F.size("of_u") + F.size("of_v") - shared) * low
    links = materialise(maybe.join(side("u"), "u").join(side("v"), "v").filter(enough).select("u", "v"), "links")
    discard(told, maybe, sets)
    wanted.unpersist()
    return links


def _pairs_apart(met: DataFrame, group: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs of different groups that meet under a token and may be near.

    Only tokens that still have several groups are looked at. Those with very many rows are cut into blocks, and each two
    blocks are a cell of both.
    """
    grouped = materialise(met.join(group, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "grouped")
    counts = grouped.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("groups"))
    blocks = F.ceil(F.col("n") / TOKEN_ROWS).cast("int")
    rows = grouped.join(counts.filter("groups > 1").select("token", blocks.alias("blocks")), "token")
    told = facts.filter("coarse is not null").groupBy("doc").agg(F.min("coarse").alias("coarse"))
    rows = materialise(rows.join(told, "doc"), "rows")
    discard(grouped)
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    cell = F.when(F.col("blocks") == 1, F.col("token")).otherwise(pair)
    block = F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))
    width = max(shuffle_width(met.sparkSession), -(-rows.count() // TASK_ROWS))
    cells = dealt.select(cell.alias("cell"), "doc", "size", "pos", "group", block.alias("block"), "coarse")
    apart = materialise(map_batches(cells.repartition(width, "cell"), _apart, "u bigint, v bigint").distinct(), "apart")
    discard(rows)
    return apart


def near_links(texts: DataFrame, facts: DataFrame, words: int = WORDS) -> DataFrame:
    """Links ``(u, v)`` between set names that connect all sets of Jaccard similarity 0.8 or more.

    ``texts`` has ``key`` and ``text``, ``facts`` what ``_facts`` tells of them. First the pairs that SimHash proposes are
    compared. What it leaves apart goes on: each token's least set is compared with the others that have the token; this
    joins large groups. Then all pairs are compared that meet and are not joined yet. Tables that are done with are removed.
    """
    spark = texts.sparkSession
    width = lambda rows: max(shuffle_width(spark), -(-rows // TASK_ROWS))
    proposed = fingerprint_pairs(facts)
    alike = _near(proposed, texts, facts, words)
    joined = materialise(components(alike).select(F.col("node").alias("doc"), F.col("root").alias("group")), "joined")
    total = facts.agg(F.sum(F.size("prefix"))).first()[0] or 0
    prefixes = facts.filter("prefix is not null").select(F.posexplode("prefix").alias("pos", "token"), "doc", "size")
    dealt = prefixes.select("token", "doc", "size", "pos").repartition(width(total), "token").sortWithinPartitions("token", "doc")
    met = materialise(map_batches(dealt, _meet, MET), "met")
    apart = materialise(met.join(joined, "doc", "left").withColumn("group", F.coalesce("group", "doc")), "apart")
    least = apart.groupBy("token").agg(F.min(F.struct("doc", "size", "pos", "group")).alias("a"))
    stars = (
        apart.join(least, "token")
        .filter((F.col("group") != F.col("a.group")) & may_be_near(F.col("size"), F.col("pos"), F.col("a.size"), F.col("a.pos")))
        .select(F.col("a.doc").alias("u"), F.col("doc").alias("v"))
        .distinct()
    )
    stars = materialise(stars, "pairs")
    discard(apart)
    links = alike.unionByName(_near(stars, texts, facts, words))
    group = components(links).select(F.col("node").alias("doc"), F.col("root").alias("group"))
    apart = _pairs_apart(met, group, facts)
    seen = stars.unionByName(proposed)
    rest = materialise(apart.join(seen, ["u", "v"], "left_anti"), "pairs")
    discard(met, apart, stars, proposed, joined)
    more = _near(rest, texts, facts, words)
    discard(rest)
    return links.unionByName(more)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, key, root)`` of every row: ``root`` names the group that near copies connect.

    Near copies are texts whose sets of ``words``-word runs have a Jaccard similarity of 0.8 or more; a shorter text is
    one run. A null text is empty, and empty texts are copies of one another. A null id keeps its row. Repeated rows
    each return. An empty table gives an empty table. Other columns are ignored.
    """

    texts = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        key_of(F.col(id_col), F.col(text_col)).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts.select("key", "text"), words))
    facts = materialise(map_batches(texts, _facts(common, words), FACTS), "facts")
    roots = components(near_links(texts.select("key", "text"), facts, words))
    root = F.coalesce("root", "doc").alias("root")
    groups = materialise(facts.join(roots, facts["doc"] == roots["node"], "left").select("doc_id", "key", root), "groups")
    discard(facts)
    return groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the smallest id stays (nulls last, then by text hash)."""
    groups = near_groups(docs, id_col, text_col, words)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    rows = docs.select(packed_row(docs).alias("_row"), key_of(F.col(id_col), F.col(text_col)).alias("_key"))
    # One shuffle by key serves the join and the choice among rows that repeat id and text.
    kept = rows.join(first.select(F.col("first.key").alias("_key")).distinct(), "_key", "left_semi")
    one = Window.partitionBy("_key").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select("_row.*")
