from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import xxhash
from edges import order, rows, table
from pyspark.sql import functions as F

from holdscope.llm import fingerprints


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def brute(text: str) -> tuple[int, int]:
    words = re.split("[ \t\n\x0b\f\r]+", text.lower())
    votes, total = np.zeros(128, np.int64), 0
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        weight = len(a) + len(b or "") + 1
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        h1 = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)
        for half, value in enumerate((h, h1)):
            votes[64 * half : 64 * half + 64] += weight * np.array([value >> i & 1 for i in range(64)])
        total += weight
    bits = [int(2 * v > total) for v in votes]
    return tuple(signed(sum(b << i for i, b in enumerate(bits[s : s + 64]))) for s in (0, 64))


def check(spark, data):
    done = fingerprints.fingerprints(table(spark, data)).collect()
    assert len(done) == len(data)
    line = sorted(data, key=lambda r: -r[0])
    got = {r.row.doc_id: r for r in done}
    for i, (d, t) in enumerate(line):
        text, after = t or "", line[(i + 1) % len(line)][1] or ""
        cut = len(text) // 3
        edit = text[: len(text) - cut] + after[:cut]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert ((r.f0, r.f1), (r.e0, r.e1), (r.n0, r.n1)) == (brute(text), brute(edit), brute(after))


def test_texts_edits_and_next(spark):
    seen = set()
    data = [r for r in rows() if r[0] is not None and not (r[0] in seen or seen.add(r[0])) and len(r[1] or "") < 40_000]
    check(spark, data)


def test_one_row_is_its_own_next(spark):
    check(spark, [(7, "abc def ghi")])


def test_nulls_and_repeated_rows(spark):
    done = fingerprints.fingerprints(table(spark)).collect()
    assert len(done) == len(rows()) == len(order(rows()))
    by_text = {}
    for r in done:
        by_text.setdefault((r.row.doc_id, r.n_chars), set()).add((r.f0, r.f1))
    assert all(len(v) == 1 for v in by_text.values() if v)
    assert fingerprints.fingerprints(table(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = fingerprints.fingerprints(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_radius_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = [(int(a), int(b)) for a, b in rng.integers(-(2**63), 2**63 - 1, (15, 2))]
    prints = set(centres)
    for a, b in centres:
        for _ in range(12):
            for at in rng.integers(0, 128, rng.integers(1, 5)).tolist():
                a, b = (signed((a % 2**64) ^ 1 << at), b) if at < 64 else (a, signed((b % 2**64) ^ 1 << (at - 64)))
            prints.add((a, b))
    df = spark.createDataFrame(sorted(prints) * 2, "f0 bigint, f1 bigint")
    distance = lambda p, q: ((p[0] ^ q[0]) % 2**64).bit_count() + ((p[1] ^ q[1]) % 2**64).bit_count()
    for radius in (0, 3, 6):
        asked = df.filter(F.pmod("f0", F.lit(2)) == 0)
        got = sorted((r.q0, r.q1, r.f0, r.f1, r.bits) for r in fingerprints.within_radius(asked, df, radius).collect())
        want = sorted(
            (*p, *q, distance(p, q)) for p in prints if p[0] % 2 == 0 for q in prints if distance(p, q) <= radius
        )
        assert got == want


def test_likeness_scale(spark):
    values = spark.range(0, 129, 32).select(fingerprints.likeness(F.col("id"))).collect()
    assert [round(v[0], 6) for v in values] == [round(max(0.0, math.cos(math.pi * b / 128)), 6) for b in range(0, 129, 32)]
