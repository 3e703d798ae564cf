"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the vocabulary holds a white-space marker after another character, so a marked word (its leading
markers and what follows up to the next marker) is segmented the same wherever it stands. A task segments each
distinct marked word once and joins ids and decoded text back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.llm.common import map_batches

MARK = "▁"
#: Chunks in the younger half of a task's table; when it is full, it becomes the older half.
TABLE_CHUNKS = 150_000
#: Longer chunks are segmented, but not kept.
KEPT_CHARS = 64
#: Characters of ids in a batch of results.
BATCH_CHARS = 8 << 20


class ChunkTable(dict):
    """Chunk to ``(ids in decimal joined by commas, number of ids, decoded text)``."""

    def __init__(self, path: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        odd = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(pieces))]
        joined = [p for p, skip in zip(pieces, odd, strict=True) if not skip and len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces of this model cross white-space markers: its words cannot be segmented alone")
        if model.normalize(" \u00a0\ufb01 e\u0301\uff21 ") != f"{MARK * 2}\u00a0\ufb01{MARK}e\u0301\uff21{MARK}":
            raise ValueError("this model rewrites texts: positions of its words are not those of the text")
        # What no piece joins with anything is a chunk of its own. A line feed usually is.
        alone = "" if any("\n" in p for p in pieces) else "\n"
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else "")).findall
        # A text gets a marker in front. Behind a guard that joins with nothing, a chunk is segmented as it stands.
        self.guard = alone or "a"
        self.skip = len(model.encode(self.guard))
        self.model = model
        self._older: dict[str, tuple] = {}

    def segment(self, chunk: str) -> tuple[str, int, str]:
        ids = self.model.encode(self.guard + chunk)
        text = self.model.decode(ids)[len(self.guard) :]
        ids = ids[self.skip :]
        return ",".join(map(str, ids)), len(ids), text

    def __missing__(self, chunk: str) -> tuple[str, int, str]:
        entry = self._older.get(chunk) or self.segment(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= TABLE_CHUNKS:
                self._older = dict(self)
                self.clear()
            self[chunk] = entry
        return entry

    def encode(self, text: str | None) -> tuple[str, int, str]:
        """Ids as decimal text, their number, and what they decode to."""
        if not text:
            return "", 0, ""
        entries = [self[c] for c in self.cut(MARK + text.replace(" ", MARK))]
        # Decoding drops the space of the marker that encoding put in front.
        return ",".join([e[0] for e in entries]), sum([e[1] for e in entries]), "".join([e[2] for e in entries])[1:]


@lru_cache(maxsize=2)
def chunk_table(path: str) -> ChunkTable:
    """The table of this Python worker; it lives as long as the worker does."""
    return ChunkTable(path)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every row; ``ids`` is decimal text joined by commas.

    ``model`` is the file of a SentencePiece model that neither rewrites texts nor joins across white space; another
    one is refused. A null text is empty: no ids, empty decoded text. A null id stays null, repeated rows each return,
    an empty table gives an empty table, and other columns are ignored. Results leave a task in bounded batches.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in batches:
            found, begin, size = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                found.append(table.encode(text.as_py()))
                size += len(found[-1][0])
                if size >= BATCH_CHARS or i == batch.num_rows - 1:
                    ids, counts, decoded = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(begin, len(found)),
                            pa.array(counts, pa.int64()),
                            pa.array(ids, pa.string()),
                            pa.array(decoded, pa.string()),
                        ],
                        ["doc_id", "n_tokens", "ids", "decoded"],
                    )
                    found, begin, size = [], i + 1, 0

    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids string, decoded string")
