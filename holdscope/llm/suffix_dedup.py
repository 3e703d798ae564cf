"""Removal of repeated passages, by longest-previous-factor arrays over candidate suffixes.

Every window of ``length`` bytes has an anchor: the leftmost of its grams with the smallest hash. Equal windows have
equal anchors at equal offsets, so windows are brought together by their anchor's hash and only texts around
anchors that occur more than once are compared. The windows of one anchor occurrence are adjacent; together they are a
segment.

1. Segments meet by anchor. Of equal segments the earliest is kept as their representative; the windows of all others
   start earlier too, so their bytes go.
2. Where an anchor has several different segments, the bytes of the representatives are fetched. Their windows are
   put in suffix order; the previous and next smaller positions in that order give each window's longest
   previous factor, and a window with a factor of full length goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import discard, map_batches, materialise, packed_row, ragged_ranges, shuffle_width, text_bytes

LENGTH = 100
GRAM = 24
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
#: Anchors with more different segments are compared window by window, spread by the windows' content.
HOT_SEGMENTS = 50_000
#: Windows that are put in suffix order at a time.
SORTED_WINDOWS = 100_000
NO_ID = np.iinfo(np.int64).max

MULTIPLIER = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MULTIPLIER)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all runs of ``gram`` bytes, by doubling.

    A run's hash is the sum of its bytes times powers of a multiplier, modulo 2**64, mixed at the end. Runs whose
    widths are powers of two are made one from another; the wanted width is put together from them.
    """
    doubled, width, factor = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    total, have, scale = None, 0, 1
    while True:
        if gram & width:
            part = doubled[have:]
            total = part if total is None else total[: len(part)] + np.uint64(scale) * part
            have, scale = have + width, scale * factor % (1 << 64)
        if 2 * width > gram:
            return _mixed(total[: max(0, len(data) - gram + 1)])
        doubled = doubled[: max(0, len(doubled) - width)] + np.uint64(factor) * doubled[width:]
        factor, width = factor * factor % (1 << 64), 2 * width


def window_anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of each ``span`` consecutive hashes, the leftmost of equals."""
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        order = np.minimum(order[: len(order) - width], order[width:])
        width *= 2
    if width < span:
        shift = span - width
        order = np.minimum(order[: len(order) - shift], order[shift:])
    return (order & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(doc, anchor hash, start, size, segment hash)`` of all segments of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    joined = b"".join(texts)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    data = np.frombuffer(joined, np.uint8)
    hashes = gram_hashes(data, gram)
    anchors = window_anchors(hashes, length - gram + 1)
    at = ragged_ranges(begins, windows)
    doc = np.repeat(np.arange(len(texts)), windows)
    anchor = anchors[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    low, high = at[first], at[last] + length
    digest = xxhash.xxh3_64_intdigest
    prints = np.array([digest(joined[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], np.uint64)
    return doc[first], hashes[anchor[first]], low - begins[doc[first]], high - low, prints


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in order, the common prefix with the nearest one before it that starts earlier (else 0).

    ``lcp[i]`` is the common prefix of suffixes i-1 and i. All pointers jump at once over what starts later.
    """
    n = len(position)
    before = np.arange(n) - 1
    common = lcp.copy()
    todo = np.arange(1, n)
    while len(todo):
        at = before[todo]
        todo = todo[(at >= 0) & (position[np.maximum(at, 0)] > position[todo])]
        at = before[todo]
        common[todo] = np.minimum(common[todo], common[at])
        before[todo] = before[at]
    common[before < 0] = 0
    return common


def longest_previous_factor(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """For each window (rows of bytes), the longest prefix that some earlier position begins with.

    Windows are put in suffix order, here cut at the window's size; the longest previous factor is with the previous
    or the next smaller position in that order.
    """
    n, length = windows.shape
    rows = np.ascontiguousarray(windows)
    order = np.lexsort((position, rows.view(f"S{length}").ravel()))
    ordered, at = rows[order], position[order]
    lcp = np.zeros(n, np.int64)
    differ = ordered[1:] != ordered[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    up = previous_smaller(at, lcp)
    turned = np.zeros(n, np.int64)
    turned[1:] = lcp[:0:-1]
    down = previous_smaller(at[::-1], turned)[::-1]
    factor = np.empty(n, np.int64)
    factor[order] = np.maximum(up, down)
    return factor


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _ranks(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Position of each row in the order of documents and starts; equal rows share it."""
    order = np.lexsort((start, key, doc))
    new = np.ones(len(order), np.int64)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1]) | (start[order][1:] != start[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _first_of(groups: list[np.ndarray], doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group and position, and where in it a group begins."""
    order = np.lexsort((start, key, doc, *groups[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    return order, new


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found) if found else None


CUTS = "doc_id bigint, key int, anchor bigint, print bigint, start bigint, size int, hot boolean"


def _batch(doc: np.ndarray, key: np.ndarray, anchor: np.ndarray | None, prints, start, size, hot=None) -> pa.RecordBatch:
    n = len(doc)
    none = lambda kind: pa.nulls(n, kind)
    columns = [
        pa.array(doc, mask=(doc == NO_ID) & (key >= 0)),
        pa.array(key.astype(np.int32)),
        none(pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)),
        none(pa.int64()) if prints is None else pa.array(prints.view(np.int64)),
        pa.array(start.astype(np.int64)),
        pa.array(size.astype(np.int32)),
        none(pa.bool_()) if hot is None else pa.array(hot),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CUTS.split(", ")])


def _find_segments(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = _ids(batch.column("doc_id")), batch.column("key").to_numpy()
            block, begin, size = [], 0, 0
            for i, text in enumerate(text_bytes(batch.column("text"))):
                block.append(text)
                size += len(text)
                if size < BLOCK and i < batch.num_rows - 1:
                    continue
                at, anchor, start, span, prints = segments(block, length, gram)
                doc, key = docs[begin + at], keys[begin + at]
                # Of segments that repeat within the block only the first goes on to the shuffle.
                order, new = _first_of([anchor, prints], doc, key, start)
                first, copies = order[new], order[~new]
                same = np.zeros(len(order), bool)  # rows that repeat id and text are one document
                same[1:] = ~new[1:] & (_ranks(doc, key, start)[order][1:] == _ranks(doc, key, start)[order][:-1])
                copies = copies[~same[~new]]
                yield _batch(doc[first], key[first], anchor[first], prints[first], start[first], span[first])
                if len(copies):
                    yield _batch(doc[copies], key[copies], None, None, start[copies], span[copies])
                block, begin, size = [], i + 1, 0

    return run


def _resolve_segments(hot_segments: int):
    """Rows of whole anchors in; out come spans to remove (no anchor) and representatives to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        removed = table.filter(table.column("anchor").is_null())
        if removed.num_rows:
            yield from removed.combine_chunks().to_batches()
        table = table.filter(table.column("anchor").is_valid())
        doc, key, start = _ids(table.column("doc_id")), table.column("key").to_numpy(), table.column("start").to_numpy()
        anchor, prints = (table.column(c).to_numpy() for c in ("anchor", "print"))
        size = table.column("size").to_numpy()
        # Most anchors occur once; only the others are put in order.
        by = np.argsort(anchor, kind="stable")
        change = np.flatnonzero(np.diff(anchor[by])) + 1
        runs = np.diff(np.concatenate([[0], change, [len(by)]]))
        more = by[np.repeat(runs > 1, runs)]
        doc, key, start, anchor, prints, size = (x[more] for x in (doc, key, start, anchor, prints, size))
        order, new = _first_of([anchor, prints], doc, key, start)
        doc, key, start, anchor, prints, size = (x[order] for x in (doc, key, start, anchor, prints, size))
        again = np.zeros(len(order), bool)
        again[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1]) & ~new[1:]
        gone = ~new & ~again
        if gone.any():
            yield _batch(doc[gone], key[gone], None, None, start[gone], size[gone])
        doc, key, start, anchor, prints, size = (x[new] for x in (doc, key, start, anchor, prints, size))
        change = np.flatnonzero(np.diff(anchor)) + 1
        runs = np.diff(np.concatenate([[0], change, [len(anchor)]]))
        kinds = np.repeat(runs, runs) if len(anchor) else runs
        several = kinds > 1 if len(anchor) else np.zeros(0, bool)
        if several.any():
            yield _batch(
                doc[several], key[several], anchor[several], prints[several], start[several], size[several],
                kinds[several] > hot_segments,
            )

    return run


def _fetch_segments(length: int):
    """Texts with their representatives in; out come the representatives' bytes by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]

            def flush(out=out):
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
                for column in out:
                    column.clear()
                return pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "key", "start", "bytes"])

            rows = zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), text_bytes(batch.column("text")), batch.column("parts"), strict=True)
            for doc_id, key, text, parts in rows:
                for part in parts.as_py():
                    seg = text[part["start"] : part["start"] + part["size"]]
                    if part["hot"]:
                        cut = [(o, seg[o : o + length]) for o in range(part["size"] - length + 1)]
                        found = [(xxhash.xxh3_64_intdigest(w) - (1 << 63), o, w) for o, w in cut]
                    else:
                        found = [(part["anchor"], 0, seg)]
                    for anchor, shift, seg in found:
                        for column, value in zip(out, (anchor, doc_id, key, part["start"] + shift, seg), strict=True):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield flush()
            if out[0]:
                yield flush()

    return run


def _compare_segments(length: int, sorted_windows: int):
    """Segments of whole anchors in; out come the spans that an earlier factor covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        anchor = table.column("anchor").to_numpy()
        doc, key, start = _ids(table.column("doc_id")), table.column("key").to_numpy(), table.column("start").to_numpy()
        # Rows that repeat id and text are one document: each brings the same segments, one of them is compared.
        by = np.lexsort((start, key, doc, anchor))
        new = np.ones(len(by), bool)
        new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (anchor, doc, key, start)], axis=0)
        by = by[new]
        table = table.take(pa.array(by))
        anchor, doc, key, start = (x[by] for x in (anchor, doc, key, start))
        parts = table.column("bytes").to_pylist()
        counts = np.array([len(p) - length + 1 for p in parts], np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
        weight = np.add.reduceat(counts, edges[:-1])
        turn = np.cumsum(weight) // sorted_windows
        groups = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(turn)]])
        for g, h in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            a, b = int(edges[g]), int(edges[h])
            data = np.frombuffer(b"".join(parts[a:b]), np.uint8)
            sizes = counts[a:b] + length - 1
            begin = np.cumsum(sizes) - sizes
            at = ragged_ranges(begin, counts[a:b])
            of = a + np.repeat(np.arange(b - a), counts[a:b])
            windows = np.lib.stride_tricks.sliding_window_view(data, length)[at]
            where = start[of] + at - begin[of - a]
            factor = longest_previous_factor(windows, _ranks(doc[of], key[of], where))
            gone = np.flatnonzero(factor >= length)
            if not len(gone):
                continue
            # Adjacent windows of a segment are one span.
            new = np.ones(len(gone), bool)
            new[1:] = (np.diff(gone) != 1) | (np.diff(of[gone]) != 0)
            first = gone[new]
            last = gone[np.append(np.flatnonzero(new)[1:], len(gone)) - 1]
            yield _batch(doc[of[first]], key[of[first]], None, None, where[first], where[last] - where[first] + length)

    return run


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted maximal runs ``(begin, end)`` of overlapping or touching spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _cut_texts(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for text, starts, sizes in zip(text_bytes(batch.column("text")), batch.column("starts"), batch.column("sizes"), strict=True):
            if not starts.is_valid:
                spans.append([])
                kept.append(text)
                continue
            begin = starts.values.to_numpy(zero_copy_only=False)
            runs = merge_spans(np.stack([begin, begin + sizes.values.to_numpy(zero_copy_only=False)], axis=1))
            stops = [0, *runs[:, 1].tolist()]
            kept.append(b"".join(text[a:b] for a, b in zip(stops, [*runs[:, 0].tolist(), len(text)], strict=True)))
            spans.append(runs.ravel().tolist())
        if as_text:
            kept = [k.decode(errors="ignore") for k in kept]
        out = pa.array(kept, pa.string() if as_text else pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), out, pa.array(spans, pa.list_(pa.int64()))], ["row", "kept", "removed"]
        )


def dedup_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    hot_segments: int = HOT_SEGMENTS,
    sorted_windows: int = SORTED_WINDOWS,
    as_text: bool = False,
) -> DataFrame:
    """``(row, kept, removed)``: each row as a struct, the bytes that stay, and the byte spans that went.

    With ``as_text`` what stays is text, without characters that lost some of their bytes.

    A byte of a text's UTF-8 form goes if it lies in a string of ``length`` bytes that also starts earlier: in a
    document with a smaller id, or before it in the same document. Strings are judged on the input, overlaps count,
    and none crosses documents. ``removed`` lists maximal spans as begin, end, begin, end, ...

    A null text is empty. Null ids come after all others; rows that share an id but differ in text are ordered by
    a hash of the text; rows that repeat both are one document and each returns its result. An empty table gives an
    empty table. All columns of the input are in ``row``, so none can clash with a name used here. One anchor's
    different segments, some 50 bytes each, must fit one task.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    hashed = F.hash(F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        # Without an id the key is not negative, so null ids are told from the largest id and come after it.
        F.when(F.col(id_col).isNull(), hashed.bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(hashed.bitwiseOR(F.lit(-(1 << 31)))).alias("key"),
        F.col(text_col).cast("string").alias("text"),
        packed_row(docs, [c for c in docs.columns if c != text_col]).alias("row"),
    )
    found = map_batches(rows.select("doc_id", "key", "text"), _find_segments(length, gram), CUTS)
    met = found.repartition(width, F.coalesce("anchor", F.xxhash64("doc_id", "key")))
    resolved = materialise(map_batches(met, _resolve_segments(hot_segments), CUTS), "segments")

    # Texts are shuffled twice, but no step keeps the files of the one before it.
    same = lambda other: rows["doc_id"].eqNullSafe(other["_id"]) & (rows["key"] == other["_key"])
    wanted = (
        resolved.filter("anchor is not null")
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_list(F.struct("anchor", "start", "size", "hot")).alias("parts"))
    )
    fetched = map_batches(
        rows.join(wanted, same(wanted)).select("doc_id", "key", "text", "parts"),
        _fetch_segments(length),
        "anchor bigint, doc_id bigint, key int, start bigint, bytes binary",
    )
    compared = map_batches(fetched.repartition(width, "anchor"), _compare_segments(length, sorted_windows), CUTS)
    spans = (
        resolved.filter("anchor is null")
        .unionByName(compared)
        .groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
        .agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    )
    spans = materialise(spans, "spans")
    discard(resolved)
    cut = rows.join(spans, same(spans), "left").select("text", "starts", "sizes", "row")
    kind = "string" if as_text else "binary"
    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept {kind}, removed array<bigint>"
    return map_batches(cut, partial(_cut_texts, as_text=as_text), schema)
