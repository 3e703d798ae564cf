from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from edges import rows, table
from pyspark.sql import functions as F

from holdscope.llm import lm_scoring
from holdscope.llm.common import ASCII_LOWER

def learns():
    return F.col("doc_id") % 3 != 1


def tokens(text: str | None) -> list[bytes | None]:
    return [*(text or "").encode().translate(ASCII_LOWER).split(), None]


def expected(data, prior, order):
    """The model in plain dictionaries, with exact filters."""
    learnt = [tokens(t) for d, t in data if d is not None and (abs(d) % 3 if d > 0 else -(abs(d) % 3)) != 1]
    counts: Counter = Counter(w for doc in learnt for w in doc)
    total, distinct = sum(counts.values()), len(counts)
    runs: Counter = Counter()
    for doc in learnt:
        padded = [None] * (order - 1) + doc
        for n in range(1, order + 1):
            for i in range(order - 1, len(padded)):
                runs[tuple(padded[i - n + 1 : i + 1])] += 1
    level = lambda c: int(np.searchsorted(lm_scoring.SCALE, c, side="right"))
    least = lambda c: 0 if c == 0 else int(lm_scoring.SCALE[level(c) - 1])
    most = lambda c: 0 if c == 0 else int(lm_scoring.SCALE[level(c)] - 1)
    quantised = sum(least(c) for c in counts.values())
    out = []
    for d, t in data:
        doc = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in doc)
        score = 0.0
        for i, w in enumerate(doc):
            p = (least(counts[w]) + 1) / (quantised + distinct + 1)
            for n in range(2, order + 1):
                before = tuple(([None] * (n - 1) + doc)[i : i + n - 1])
                history = runs[before] if any(b is not None for b in before) else counts[None]
                p = (least(runs[(*before, w)]) + prior * p) / (most(history) + prior)
            score += math.log10(p)
        out.append((d is None, d or 0, len(doc), sum(counts[w] > 0 for w in doc), base, score))
    return sorted(out), total, distinct


@pytest.mark.parametrize(("order", "shard_bytes"), [(1, 1 << 20), (2, 1 << 20), (2, 300), (3, 2000)])
def test_scores_as_plain_dictionaries(spark, order, shard_bytes):
    """With many bits an item the filter errs almost never; shards change nothing."""
    done, totals = lm_scoring.score(
        table(spark), learns(), order=order, bits_per_item=64, prior=7.0, shard_bytes=shard_bytes, parts=16
    )
    want, total, distinct = expected(rows(), 7.0, order)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in done.collect())
    assert (totals.tokens, totals.distinct) == (total, distinct)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_levels_of_a_filter():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    levels = rng.integers(1, 40, 5000)
    filled = lm_scoring.build_filter(hashes, levels, 8)
    shard = lm_scoring.Shard(1, 0, filled, np.array([len(filled)]), hashes[:0], np.empty(0, np.int64))
    read = shard.levels(hashes)
    assert (read >= levels).all() and (read == levels).mean() > 0.95
    assert (shard.levels(rng.integers(0, 2**63, 5000, dtype=np.uint64)) == 0).mean() > 0.95


def test_nothing_to_learn_from(spark):
    done, totals = lm_scoring.score(table(spark), F.lit(False))
    assert totals.tokens == 0
    assert all(r.n_known == 0 and r.base_score == 0.0 for r in done.collect())
    done, _ = lm_scoring.score(table(spark, []), learns())
    assert done.count() == 0


def test_long_tokens_and_texts():
    texts = [b"A" * 10_000 + b" b", b"", b"a" * 10_000]
    hashes, counts = lm_scoring.token_hashes(texts)
    assert counts.tolist() == [3, 1, 2]
    assert hashes[0] == hashes[4] and hashes[2] == hashes[3] == hashes[5] == lm_scoring.END
