"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string ends in one token of its own encoding, and the encoding of the whole is found by going
back from token to token. That last token is the one that stays apart from the last token of what stands before it.
So prefixes are stored, not merges: an append goes on from the last prefix, a word takes over the prefixes that it
shares with the word sorted before it, and an edit changes what lies behind it alone.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import map_batches, ragged_ranges

#: White space as a pattern of the tokenizer has it; Python's own ``\s`` has four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks in the younger half of a task's table; when it is full, it becomes the older half.
TABLE_CHUNKS = 200_000
#: Longer chunks are encoded, but not kept.
KEPT_CHARS = 64
#: Longer pieces are encoded one by one, the others side by side, so many at a time.
SIDE_BY_SIDE, PIECES = 40, 1 << 17
#: Pairs of tokens whose standing is remembered.
KEPT_PAIRS = 1 << 18
#: Tokens spelled out at a time.
SPELLED = 1 << 18
#: Bytes of decoded text in a batch of results.
BATCH_BYTES = 8 << 20
#: The longest look ahead of the pattern behind the end of a match.
AHEAD = 3
NEVER = 1 << 62


class Ranks:
    """The vocabulary: tokens with their ranks, how each is put together, and which two stay apart."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        #: Length of the longest token that ends in these two bytes.
        self.reach: dict[bytes, int] = {}
        for token in self.rank:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 0))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this one joins; none if merges never lead to it."""
        if rank not in self._halves:
            parts = [self.token[rank][i : i + 1] for i in range(len(self.token[rank]))]
            while len(parts) > 2:
                best, at = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if best >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[rank] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[rank]

    def whole(self, rank: int) -> bool:
        """Whether the token's bytes alone are encoded as this token."""
        return len(self.token[rank]) == 1 or self.halves(rank) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether these tokens, side by side, are the encoding of their bytes.

        Merges are undone from the last one back. At each moment one token stands on either side of the border; the two
        would have merged if their own rank came before the merges that took them away. Of equal ranks the left one is first.
        """
        known = self._apart.get((left, right))
        if known is not None:
            return known
        token, rank = self.token, self.rank
        x, y, x_gone, y_gone = left, right, NEVER, NEVER
        formed = lambda t: t if len(token[t]) > 1 else -1
        stay = True
        while stay:
            joined = rank.get(token[x] + token[y], NEVER)
            if joined < x_gone and joined <= y_gone:
                stay = False
            elif formed(x) > formed(y):
                parts = self.halves(x)
                stay = parts is not None
                if stay:
                    x, x_gone = parts[1], x
            elif formed(y) >= 0:
                parts = self.halves(y)
                stay = parts is not None
                if stay:
                    y, y_gone = parts[0], y
            else:
                break
        if len(self._apart) >= KEPT_PAIRS:
            self._apart.clear()
        self._apart[left, right] = stay
        return stay


class Prefixes:
    """A byte string and the last token of each of its prefixes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks = ranks
        self.data = b""
        self.last = array("I", [0])
        self.replace(data)

    def replace(self, data: bytes) -> None:
        """Another string; prefixes that both have are kept."""
        same = 0
        for a, b in zip(self.data, data, strict=False):
            if a != b:
                break
            same += 1
        self._extend(data, same)

    def append(self, more: bytes) -> None:
        self._extend(self.data + more, len(self.data))

    def _extend(self, data: bytes, known: int) -> None:
        last, reach, rank = self.last, self.ranks.reach, self.ranks.rank
        seen, whole, apart = self.ranks._apart.get, self.ranks.whole, self.ranks.apart
        del last[known + 1 :]
        self.data = data
        for end in range(known + 1, len(data) + 1):
            longest = reach.get(data[end - 2 : end], 1) if end > 1 else 1
            for begin in range(max(0, end - longest), end):
                found = rank.get(data[begin:end])
                if found is None:
                    continue
                if begin:
                    before = last[begin]
                    stays = seen((before, found))
                    if stays is None:
                        stays = apart(before, found)
                else:
                    stays = whole(found)
                if stays:
                    last.append(found)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the prefix of so many bytes; of all of them by default. A string that is a token is that token."""
        end = len(self.data) if end is None else end
        alone = self.ranks.rank.get(self.data[:end])
        if alone is not None:
            return [alone]
        out, token = [], self.ranks.token
        while end:
            out.append(self.last[end])
            end -= len(token[out[-1]])
        return out[::-1]


class EditedText:
    """A text with the matches of the pattern, each with its prefixes, that is encoded anew only near edits."""

    def __init__(self, ranks: Ranks, pattern: str, text: str = ""):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.text, self.ends, self.parts = "", [], []
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``begin`` to ``end``."""
        old, ends, parts = self.text, self.ends, self.parts
        self.text = old[:begin] + new + old[end:]
        shift = len(new) - (end - begin)
        # Matches that ended long enough before the edit never looked at it.
        keep = 0
        while keep < len(ends) and ends[keep] + AHEAD <= begin:
            keep += 1
        at = ends[keep - 1] if keep else 0
        self.ends, self.parts = ends[:keep], parts[:keep]
        later = {e + shift: i for i, e in enumerate(ends) if e >= end}
        reused = parts[keep] if keep < len(parts) else None
        while at < len(self.text):
            match = self.find.match(self.text, at)
            data = match.group().encode()
            if reused is not None:
                part, reused = reused, None
                part.replace(data)
            else:
                part = Prefixes(self.ranks, data)
            self.parts.append(part)
            at = match.end()
            self.ends.append(at)
            if at in later and at >= begin + len(new):
                # From a common border on, the same text has the same matches.
                i = later[at] + 1
                self.ends += [e + shift for e in ends[i:]]
                self.parts += parts[i:]
                break

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part.ids()]


class SideBySide:
    """The same prefixes for many strings at once: a row per string, a column per prefix."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        n = max(ranks.token) + 1
        self.size = np.zeros(n, np.int64)
        self.left, self.right, self.formed = (np.full(n, -1, np.int64) for _ in range(3))
        pairs: dict[int, int] = {}
        # Tokens as a trie: the next node by node and byte, and the token that ends in a node.
        nodes: dict[bytes, int] = {b"": 0}
        edges = []
        for token, rank in ranks.rank.items():
            self.size[rank] = len(token)
            for at, byte in enumerate(token, 1):
                if token[:at] not in nodes:
                    edges.append((nodes[token[: at - 1]], byte, len(nodes)))
                    nodes[token[:at]] = len(nodes)
            for at in range(1, len(token)):
                a, b = ranks.rank.get(token[:at]), ranks.rank.get(token[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
            if len(token) > 1:
                self.formed[rank] = rank
                parts = ranks.halves(rank)
                if parts:
                    self.left[rank], self.right[rank] = parts
        self.step = np.zeros((len(nodes), 256), np.int32)
        parent, byte, child = np.array(edges).reshape(-1, 3).T
        self.step[parent, byte] = child
        self.end = np.array([ranks.rank.get(prefix, -1) for prefix in nodes], np.int64)
        self.whole = (self.formed < 0) | (self.left >= 0)
        self.key = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.key.tolist()], np.int64)

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Ranks.apart`` of many pairs."""
        pairs, where = np.unique(left << 32 | right, return_inverse=True)
        x, y = pairs >> 32, pairs & 0xFFFFFFFF
        x_gone, y_gone = np.full(len(pairs), NEVER), np.full(len(pairs), NEVER)
        stay = self.whole[x] & self.whole[y]
        todo = np.flatnonzero(stay)
        while len(todo):
            a, b = x[todo], y[todo]
            if len(self.key):
                at = np.minimum(np.searchsorted(self.key, a << 32 | b), len(self.key) - 1)
                joined = np.where(self.key[at] == a << 32 | b, self.joined[at], NEVER)
                meet = (joined < x_gone[todo]) & (joined <= y_gone[todo])
                stay[todo[meet]] = False
                todo, a, b = todo[~meet], a[~meet], b[~meet]
            first = self.formed[a] > self.formed[b]
            second = ~first & (self.formed[b] >= 0)
            i, j = todo[first], todo[second]
            x_gone[i], x[i] = a[first], self.right[a[first]]
            y_gone[j], y[j] = b[second], self.left[b[second]]
            lost = np.concatenate([i[x[i] < 0], j[y[j] < 0]])
            stay[lost] = False
            todo = todo[(first | second) & (x[todo] >= 0) & (y[todo] >= 0)]
        return stay[where]

    def ids(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after another, and the number of each."""
        sizes = np.array([len(s) for s in strings], np.int64)
        width = int(sizes.max(initial=0))
        data = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(len(strings), width)
        last = np.full((len(strings), width + 1), -1, np.int64)
        for begin in range(width):
            rows = np.flatnonzero(sizes > begin)
            node = np.zeros(len(rows), np.int32)
            found = []
            for end in range(begin + 1, width + 1):
                node = self.step[node, data[rows, end - 1]]
                alive = (node > 0) & (sizes[rows] >= end)
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                token = self.end[node]
                some = token >= 0
                found.append((rows[some], np.full(int(some.sum()), end), token[some]))
            if not found:
                raise ValueError("the vocabulary lacks single bytes")
            row, end, token = (np.concatenate(c) for c in zip(*found, strict=True))
            stays = self.apart(last[row, begin], token) if begin else self.whole[token]
            last[row[stays], end[stays]] = token[stays]
        # From the last prefix back.
        at, rows, back = sizes.copy(), np.flatnonzero(sizes), []
        counts = np.zeros(len(strings), np.int64)
        while len(rows):
            token = last[rows, at[rows]]
            back.append((rows, token))
            counts[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        out = np.zeros(int(counts.sum()), np.int64)
        stop = np.cumsum(counts)
        for n, (rows, token) in enumerate(back):
            out[stop[rows] - 1 - n] = token
        return out, counts


class ByteTable:
    """Chunk to ids, as little-endian unsigned 32-bit integers. A chunk is what stands between white space."""

    def __init__(self, path: str, pattern: str):
        self.ranks = Ranks(path)
        self.many = SideBySide(self.ranks)
        self.cut = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.find = regex.compile(pattern).findall
        # Whether letters are one match, with or without a space in front.
        self.letters = all(self.find(w) == [w] for w in ("a", " a", "Zq", " straßeÉ中ʰ", "ǅé"))
        self.ids: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        # All tokens end to end, and where each begins.
        tokens = [self.ranks.token.get(i, b"") for i in range(len(self.many.size))]
        self._spelled = np.frombuffer(b"".join(tokens), np.uint8)
        self._begin = np.cumsum(self.many.size) - self.many.size

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        rank = self.ranks.rank
        out: list[bytes] = [b""] * len(pieces)
        short, prefixes = [], Prefixes(self.ranks)
        for i, piece in enumerate(pieces):
            alone = rank.get(piece)
            if alone is not None:
                out[i] = alone.to_bytes(4, "little")
            elif len(piece) <= SIDE_BY_SIDE:
                short.append(i)
            else:
                prefixes.replace(piece)
                out[i] = np.array(prefixes.ids(), "<u4").tobytes()
        for at in range(0, len(short), PIECES):
            some = short[at : at + PIECES]
            ids, counts = self.many.ids([pieces[i] for i in some])
            packed, begin = ids.astype("<u4").tobytes(), 0
            for i, end in zip(some, (4 * np.cumsum(counts)).tolist(), strict=True):
                out[i] = packed[begin:end]
                begin = end
        return out

    def _learn(self, chunks: set[str]) -> None:
        alone = [c for c in chunks if (c[1:] if c[0] == " " else c).isalpha()] if self.letters else []
        rest = list(chunks.difference(alone))
        split = [self.find(c) for c in rest]
        pieces = list(set(alone).union(*split))
        entry = dict(zip(pieces, self._pieces([p.encode() for p in pieces]), strict=True))
        found = self.ids
        for chunk in alone:
            found[chunk] = entry[chunk]
        for chunk, some in zip(rest, split, strict=True):
            found[chunk] = b"".join([entry[p] for p in some])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; none for a null."""
        cut = [self.cut(t) if t else [] for t in texts]
        wanted = set().union(*cut)
        new = wanted - self.ids.keys()
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            self._older, self.ids = self.ids, {}
            new = wanted
        old = new & self._older.keys()
        self.ids.update((c, self._older[c]) for c in old)
        self._learn(new - old)
        found = self.ids.__getitem__
        out = [b"".join(map(found, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del self.ids[chunk]
        return out

    def decode(self, packed: list[bytes]) -> Iterator[bytes]:
        """The bytes that the ids of each text stand for."""
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        sizes = self.many.size[ids]
        spelled = b"".join(
            self._spelled[ragged_ranges(self._begin[ids[i : i + SPELLED]], sizes[i : i + SPELLED])].tobytes()
            for i in range(0, len(ids), SPELLED)
        )
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]
        begin = 0
        for end in ends.tolist():
            yield spelled[begin:end]
            begin = end


@lru_cache(maxsize=2)
def byte_table(path: str, pattern: str) -> ByteTable:
    """The table of this Python worker; it lives as long as the worker does."""
    return ByteTable(path, pattern)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: ids as little-endian unsigned 32-bit integers, and the bytes they stand for.

    ``vocabulary`` is a file of ranks, ``pattern`` cuts a text into matches that are encoded apart, and must leave white
    space outside words as the usual ones do: a match that holds other characters has at most one space, in front.
    A match that is a token is that token; special tokens are none. A null text is empty: no ids, no bytes. A null id stays
    null, repeated rows each return, an empty table gives an empty table, and other columns are ignored. Texts are read
    whole; a match of n bytes takes 4n bytes while it is encoded. Results leave a task in bounded batches.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            begin, found, size = 0, [], 0
            packed = table.encode(texts)
            for i, entry in enumerate(zip(packed, table.decode(packed), strict=True)):
                found.append(entry)
                size += len(entry[0]) + len(entry[1])
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    ids, decoded = zip(*found, strict=True)
                    arrays = [batch.column("doc_id").slice(begin, len(found)), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"])
                    begin, found, size = i + 1, [], 0

    return map_batches(rows, run, "doc_id bigint, ids binary, decoded binary")
