from __future__ import annotations

import corpus_pipeline
import pytest
from edges import table
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_shingle_join import brute as brute_near
from test_suffix_dedup import brute as brute_passages

from holdscope.llm import line_dedup

SF = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas().sort_values("doc_id")]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test")
        out.append(docs.toPandas())
    return out


def test_columns(steps):
    for frame in steps[:-1]:
        assert list(frame.columns) == DOCUMENTS
        assert (frame.n_chars == frame.text.str.len()).all()


def test_language_keeps_clean_documents(steps):
    assert len(steps[1]) >= 0.98 * len(steps[0])


def test_lines_by_brute_force(steps):
    before = steps[1].sort_values("doc_id")
    want = {i: t for i, t in zip(before.doc_id, brute_lines(before.text.tolist(), line_dedup.MIN_CHARS), strict=True) if t}
    assert dict(zip(steps[2].doc_id, steps[2].text, strict=True)) == want


def test_near_copies_by_brute_force(steps):
    before = steps[2].sort_values("doc_id")
    ids = before.doc_id.tolist()
    assert set(steps[3].doc_id) == {ids[i] for i in brute_near(before.text.tolist())}


def test_passages_by_brute_force(steps):
    before = steps[3].sort_values("doc_id")
    texts = [t.encode() for t in before.text]
    want = {}
    for i, text, gone in zip(before.doc_id, texts, brute_passages(texts, 100), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g).decode(errors="ignore")
        if kept:
            want[i] = kept
    assert dict(zip(steps[4].doc_id, steps[4].text, strict=True)) == want


def test_pieces_cover_what_is_kept(steps):
    pieces = steps[5]
    assert set(pieces.doc_id) == set(steps[4].doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first()[0] == steps[5].length.sum()


def test_stages_stand_edge_rows(spark):
    docs = table(spark).select("doc_id", "text", "lang").withColumn("source", F.lit(None).cast("string"))
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            data = corpus_pipeline.materialise(stage(spark, data, SF), "edge")
        assert data.filter("length < 1").count() == 0
