from __future__ import annotations

import random

import numpy as np
import pytest
from edges import left, order, rows, shuffle_files, table

from holdscope.llm import suffix_dedup


def brute(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which bytes lie in a string that started earlier."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            if text[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(text[s : s + length])
        out.append(gone)
    return out


def spans(gone: np.ndarray) -> list[int]:
    edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).ravel().tolist()


def check(found, data, length):
    texts = [(t or "").encode() for _, t in data]
    for (doc_id, _), text, gone in zip(data, texts, brute(texts, length), strict=True):
        row = found[doc_id]
        assert bytes(row.kept) == bytes(np.frombuffer(text, np.uint8)[~gone])
        assert row.removed == spans(gone)


@pytest.mark.parametrize(
    ("length", "gram", "hot", "windows"), [(12, 5, 50_000, 100), (10, 3, 2, 2000), (20, 6, 1, 100), (100, 24, 50_000, 2000)]
)
def test_random_texts(spark, length, gram, hot, windows):
    rnd = random.Random(length)
    base = ["".join(rnd.choice("abé \n") for _ in range(rnd.randint(0, 8 * length))) for _ in range(10)]
    data = []
    for i in range(50):
        text = rnd.choice(base)
        if rnd.random() < 0.5:
            text = text[: rnd.randint(0, len(text))] + rnd.choice(base)[rnd.randint(0, 30) :]
        if rnd.random() < 0.2:
            text = "a" * rnd.randint(0, 300)
        data.append((i, text if rnd.random() > 0.05 else None))
    done = suffix_dedup.dedup_passages(
        table(spark, data, 5), length=length, gram=gram, hot_segments=hot, sorted_windows=windows
    )
    check({r.row.doc_id: r for r in done.collect()}, data, length)


def test_edge_rows(spark):
    """Rows that repeat id and text are one document; null ids come last."""
    docs = table(spark)
    done = suffix_dedup.dedup_passages(docs).collect()
    assert len(done) == len(rows())
    assert set(done[0].row.asDict()) == set(docs.columns) - {"text"}
    data = [r for r in order(rows()) if r[0] is not None and r[0] != 12]
    by_id = {r.row.doc_id: r for r in done if r.row.doc_id is not None}
    head = [r for r in data if r[0] < 12]
    check(by_id, head, 100)
    assert len({bytes(r.kept) for r in done if r.row.doc_id == 12}) == 2


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeated_rows_with_anchors_elsewhere(spark, hot):
    """Rows that repeat id and text lose only what starts earlier, as the one document that they are."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    phrases = [word(15) for _ in range(12)]
    data = []
    for i in range(12):
        text = "".join(word(rnd.randint(3, 30)) + p for p in rnd.sample(phrases, 8))
        data.append((i if i < 11 else None, text))
    repeated = [r for i, r in enumerate(data) for _ in range(1 + i % 3)]
    done = suffix_dedup.dedup_passages(table(spark, repeated), length=20, gram=6, hot_segments=hot, sorted_windows=100)
    found = done.collect()
    assert len(found) == len(repeated)
    texts = [t.encode() for _, t in data]
    want = {i: bytes(np.frombuffer(t, np.uint8)[~g]) for (i, _), t, g in zip(data, texts, brute(texts, 20), strict=True)}
    assert all(bytes(r.kept) == want[r.row.doc_id] for r in found)


def test_text_output_drops_cut_characters(spark):
    data = [(1, "x" * 99 + "é" + "y" * 120), (2, "q" + "©" + "y" * 120)]
    done = {r.row.doc_id: r for r in suffix_dedup.dedup_passages(table(spark, data), length=121, as_text=True).collect()}
    gone = brute([t.encode() for _, t in data], 121)
    assert gone[1][2] and not gone[1][1]
    assert done[2].kept == "q"


def test_empty_table(spark):
    assert suffix_dedup.dedup_passages(table(spark, [])).count() == 0


def test_only_spans_stay_on_disk(spark):
    """Segments and shuffles go before the texts are cut, and what is left is enough for every later read."""
    data = [(i, "".join(random.Random(i % 7).choice("abc de") for _ in range(400)) + "x" * i) for i in range(30)]
    tables, files = left(spark), shuffle_files(spark)
    done = suffix_dedup.dedup_passages(table(spark, data))
    assert {name for name, _ in left(spark) - tables} == {"spans"}
    assert shuffle_files(spark, files) <= files
    for _ in range(2):
        check({r.row.doc_id: r for r in done.collect()}, data, 100)


def test_longest_previous_factor_of_a_word():
    text = b"abaabababaa" + b"$" * 11
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), 11)[:11]
    got = suffix_dedup.longest_previous_factor(windows, np.arange(11))
    want = []
    for i in range(11):
        common = lambda j, i=i: next((k for k in range(11) if windows[i][k] != windows[j][k]), 11)
        want.append(max((common(j) for j in range(i)), default=0))
    assert got.tolist() == want
