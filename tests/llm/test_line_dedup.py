from __future__ import annotations

import random

import numpy as np
import pytest
from edges import left, order, rows, table

from holdscope.llm import line_dedup


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(texts: list[str | None], min_chars: int) -> list[str | None]:
    seen: dict[str, None] = {}
    out = []
    for text in texts:
        kept = []
        for line in [] if text is None else text.split("\n"):
            n = line_dedup.normal(line.encode()).decode()
            again = n in seen or (len(n) >= min_chars and any(len(s) >= min_chars and one_edit(s, n) for s in seen))
            if not n or not again:
                kept.append(line)
            if n:
                seen[n] = None
        out.append(None if text is None else "\n".join(kept))
    return out


@pytest.mark.parametrize(("signs", "min_chars", "seed"), [("ab", 4, 1), ("ab", 1, 2), ("abcdé ", 6, 3)])
def test_random_lines(spark, signs, min_chars, seed):
    rnd = random.Random(seed)
    line = lambda: "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 1, 3, 5, 8, 9, 10, 11, 12])))
    data = [
        (i, None if rnd.random() < 0.05 else "\n".join(line() for _ in range(rnd.randint(0, 12)))) for i in range(40)
    ]
    done = line_dedup.dedup_lines(table(spark, data), min_chars=min_chars).collect()
    got = {r.row.doc_id: r for r in done}
    for (i, text), want in zip(data, brute([t for _, t in data], min_chars), strict=True):
        assert got[i].text == want
        assert got[i].n_lines == (0 if text is None else text.count("\n") + 1)
        assert got[i].n_removed == got[i].n_lines - (0 if text is None else _lines(want, text, got[i]))


def _lines(kept: str, text: str, row) -> int:
    return row.n_lines - row.n_removed if not kept else kept.count("\n") + 1


def test_edge_rows(spark):
    docs = table(spark)
    done = line_dedup.dedup_lines(docs).collect()
    assert len(done) == len(rows())
    data = [r for r in order(rows()) if r[0] is not None and r[0] < 12]
    got = {r.row.doc_id: r.text for r in done}
    assert [got[i] for i, _ in data] == brute([t for _, t in data], line_dedup.MIN_CHARS)
    # Both copies of a repeated row return the same, null ids come last.
    assert sorted(r.n_removed for r in done if r.row.doc_id == 12)[0] >= 0
    assert {r.text for r in done if r.row.doc_id is None} <= {None, ""}


def test_repeated_rows_are_one_document(spark):
    data = [(1, "a line of some length here"), (1, "a line of some length here"), (2, "A line of some length here ")]
    got = sorted((r.row.doc_id, r.text) for r in line_dedup.dedup_lines(table(spark, data)).collect())
    assert got == [(1, data[0][1]), (1, data[0][1]), (2, "")]


def test_empty_table(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_only_places_stay_on_disk(spark):
    before = left(spark)
    line_dedup.dedup_lines(table(spark)).collect()
    assert {name for name, _ in left(spark) - before} == {"stay"}


def test_variant_hashes_are_those_of_the_shorter_lines():
    for text in ("a", "ab", "straße 中文 x", "aaaa"):
        _, variants = line_dedup.variant_hashes(text)
        for i, v in enumerate(variants.tolist()):
            shorter = text[:i] + text[i + 1 :]
            assert v == (line_dedup.variant_hashes(shorter)[0] if shorter else 0)
    assert len(np.unique(line_dedup.variant_hashes("abcdefgh")[1])) == 8
