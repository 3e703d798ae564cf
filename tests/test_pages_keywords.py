"""Deep pages from a stored order, and keyword search through trigrams."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from holdscope.functions.text import match_any
from holdscope.operators import keywords, pages


def test_every_page_of_a_stored_order(spark, tmp_path):
    rnd = random.Random(1)
    data = [(i, rnd.choice("abc"), rnd.choice([None, 1.0, 2.0])) for i in range(230)]
    rows = spark.createDataFrame(data, "id long, code string, value double").repartition(3)
    order = [F.col("value").desc_nulls_last(), F.col("code").asc(), F.col("id").asc()]
    pages.store_order(rows, order, f"{tmp_path}/o", range_rows=50)
    want = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[1], r[0]))
    last = pages.last_page(spark, f"{tmp_path}/o", 40)
    assert last == 6
    for number in range(1, last + 2):
        got = pages.read_page(spark, f"{tmp_path}/o", number, 40).collect()
        assert [tuple(r)[:3] for r in got] == want[40 * (number - 1) : 40 * number]
        assert [r["place"] for r in got] == list(range(40 * (number - 1), 40 * (number - 1) + len(got)))


def test_the_last_page_reads_one_range(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"))
    pages.store_order(rows, [F.col("id").asc()], f"{tmp_path}/o", range_rows=100)
    for file in Path(f"{tmp_path}/o/rows").glob("_range=[0-8]/part-*"):
        file.write_bytes(b"not to be read")
    page = pages.read_page(spark, f"{tmp_path}/o", 100, 10)
    assert [r["id"] for r in page.collect()] == list(range(990, 1000))


def test_an_empty_order(spark, tmp_path):
    pages.store_order(spark.range(0), [F.col("id").asc()], f"{tmp_path}/o")
    assert pages.last_page(spark, f"{tmp_path}/o") == 1
    assert pages.read_page(spark, f"{tmp_path}/o", 3).collect() == []


@pytest.mark.parametrize("keyword", ["abc", "AbC", " cab ", "ab_a", "a%bca", "ab", "%", "zzz", "abcabca", "é", "b\\_c", "bcb%cab"])
def test_keywords_against_a_plain_search(spark, keyword):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcABC_é") for _ in range(rnd.randint(0, 14)))
    data = [(i * 97, word(), rnd.choice([None, word()])) for i in range(1500)]
    rows = spark.createDataFrame(data, "product_id long, product_code string, product_name string")
    index = keywords.trigram_index(rows, "product_id", ["product_code", "product_name"]).cache()
    got = keywords.search(rows, index, "product_id", ["product_code", "product_name"], keyword)
    want = rows.filter(match_any([F.col("product_code"), F.col("product_name")], keyword))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    some = keywords.candidates(index, keyword)
    if some is not None:
        assert want.count() <= some.count() < 1500


def test_ranges_are_bounded_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MAX_RANGES", 7)
    pages.store_order(spark.range(1000), [F.col("id").asc()], f"{tmp_path}/o", range_rows=10)
    assert len(list(Path(f"{tmp_path}/o/rows").glob("_range=*"))) <= 7
    page = pages.read_page(spark, f"{tmp_path}/o", pages.last_page(spark, f"{tmp_path}/o", 40), 40)
    assert [(r["place"], r["id"]) for r in page.collect()] == [(i, i) for i in range(960, 1000)]
