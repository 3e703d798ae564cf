"""Scalar rules, parsers and return series."""

from __future__ import annotations

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from holdscope.catalogue import feeds
from holdscope.catalogue.domain import Domain
from holdscope.functions import constants as C
from holdscope.functions import parsing, text
from holdscope.operators import browse, holdings, returns, similarity, skew, timeseries
from holdscope.sources import mappings, products, quotes, reports


def apply(spark, values, fn, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_market_inference(spark):
    codes = ["600519", "688001", "000001", "300750", "830001", "430001", "00700", "01810", "AAPL", "99", " 600000 "]
    assert apply(spark, codes, text.infer_market) == ["SH", "SH", "SZ", "SZ", "BJ", "BJ", "SZ", "HK", "UNKNOWN", "UNKNOWN", "SH"]
    web = ["00700", "AAPL", "白酒", "", None, "600519", "HSI"]
    assert apply(spark, web, text.infer_market_web) == ["HK", "US", "UNKNOWN", "UNKNOWN", "UNKNOWN", "SH", "US"]
    assert apply(spark, ["白酒"], lambda c: text.infer_market_web(c, any_letter=True)) == ["US"]


def test_share_class_names(spark):
    names = ["医药基金A", "医药基金 c ", "医药基金", "Fund E　", "ETF联接B"]
    assert apply(spark, names, text.base_name) == ["医药基金", "医药基金", "医药基金", "Fund", "ETF联接"]
    assert apply(spark, names, text.has_share_class) == [True, True, False, True, True]


def test_industry_names(spark):
    names = ["白酒Ⅱ", "银行 III", "XIIII", "白酒12", "Ⅱ", "半导体"]
    assert apply(spark, names, text.shorten_industry) == ["白酒", "银行", "XI", "白酒1", "Ⅱ", "半导体"]
    assert apply(spark, ["银行Ⅱ", "银行", "白酒2", "证券II"], text.shorten_industry_report) == ["银行业", "银行业", "白酒2", "证券"]


def test_cluster_label(spark):
    rows = [([("未知行业", 0.9), ("白酒Ⅱ", 0.5), ("白酒2", 0.4), ("银行", 0.3), ("家电", 0.2), ("消费", 0.1)],), ([("家电", 0.01)],), ([],)]
    df = spark.createDataFrame(rows, "x ARRAY<STRUCT<industry: STRING, weight: DOUBLE>>")
    assert [r[0] for r in df.select(text.cluster_label(F.col("x"))).collect()] == ["白酒 + 银行 + 家电", None, None]


def test_number_texts(spark):
    money = [None, 0.5, 12.345, -23456.0, 1.5e8, 99999.99]
    assert apply(spark, money, text.money_text, "DOUBLE") == ["—", "0.5000", "12.35", "-2.35万", "1.50亿", "10.00万"]
    assert apply(spark, [1234.5, 2e4], text.amount_text, "DOUBLE") == ["1,234.50", "2.00万"]
    assert apply(spark, [1234.5, 3e4, None], lambda c: text.volume_text(c, F.lit("lot")), "DOUBLE") == ["1,234手", "3.00万手", "—"]
    assert apply(spark, ["abcdef", "abc", None], lambda c: text.truncate(c, 4)) == ["abc…", "abc", ""]
    assert apply(spark, [0.125, None], lambda c: text.percent_text(c, 100), "DOUBLE") == ["12.50%", "—"]
    assert apply(spark, ["stock", "x", "", None], lambda c: text.label(c, C.ASSET_CLASS_LABELS)) == ["股票", "x", "—", "—"]


def test_lenient_numbers(spark):
    values = [" 1,234.5 ", "-", "null", "", None, "x", "8.5%", "--"]
    as_float = [None if v is None else float(v) for v in apply(spark, values, parsing.to_decimal)]
    assert as_float == [1234.5, None, None, None, None, None, None, None]
    assert apply(spark, values, parsing.to_float) == [1234.5, None, None, None, None, None, 8.5, None]
    assert apply(spark, values, parsing.to_fraction) == [1234.5, None, None, None, None, None, pytest.approx(0.085), None]
    assert apply(spark, ["12.9", "-3.9", "a"], parsing.to_int) == [12, -3, None]
    dates = ["2026-07-27 15:30:36", "20260727", "2026/07/27", "27.07.2026", "", None]
    assert apply(spark, dates, parsing.to_date) == [date(2026, 7, 27)] * 3 + [None] * 3
    assert apply(spark, dates[:2], lambda c: parsing.to_date(c, first_ten=False)) == [None, date(2026, 7, 27)]


def test_pages():
    assert [parsing.page_number(v) for v in (None, 0, -2, 3)] == [1, 1, 1, 3]
    assert [parsing.page_size(v) for v in (None, 0, 201, 200)] == [25, 25, 25, 200]


def test_keyword_keeps_like_wildcards(spark):
    df = spark.createDataFrame([("abc",), ("aXc",), ("zzz",)], "a STRING")
    assert df.filter(text.match_any([F.col("a")], " A_C ")).count() == 2
    assert df.filter(browse.equals(a="abc", missing=None)).count() == 1


def test_risk_and_type_rules(spark):
    words = ["中低风险", "中高风险", "高风险", "R5", "", None, "其他"]
    assert apply(spark, words, lambda c: products.risk_level("BOC", c)) == ["R1", "R4", "R5", "R5", "R3", "R3", "R3"]
    assert apply(spark, ["3", "PR2"], lambda c: products.risk_level("CITIC", c)) == ["R3", "R2"]
    assert apply(spark, ["三星级", "R4", "?"], products.standard_risk) == ["L3", "L4", None]
    names = ["某某货币A", "全球QDII指数", "沪深300ETF", "纯债", "灵活配置", "权益先锋", None, "量化"]
    want = ["money_market", "qdii", "index", "fixed_income", "mixed", "equity", "other", "other"]
    assert apply(spark, names, lambda c: products.product_type("fund", c)) == want
    assert apply(spark, ["002", "混合"], lambda c: products.product_type("JX", F.lit("现金"), c)) == ["equity", "money_market"]


def test_kline_short_and_bad_lines(spark):
    lines = ["2026-07-27,10,11,12,9,100.9,1000,1,2.5,0.5,3", "2026-07-28,10,11", "nonsense"]
    rows = quotes.parse_klines(spark.createDataFrame([(x,) for x in lines], "line STRING")).orderBy("quote_date").collect()
    assert len(rows) == 2
    assert (float(rows[0]["prev_close"]), rows[0]["volume"]) == (10.5, 100)
    assert (rows[1]["prev_close"], rows[1]["high_price"], float(rows[1]["close_price"])) == (None, None, 11.0)


def test_report_sections(spark):
    html = (
        "<p>x</p><h4 class='t'><a>基金 2026年2季度股票投资明细</a></h4>截止至：<font class='a'>2026-06-29</font>"
        "<table><tr><td>h</td></tr><tr><td>1</td><td><a>600519</a></td><td>贵州&amp;茅台</td><td></td><td>9.50%</td>"
        "<td>12.5</td><td>1,234.00</td></tr><tr><td>short</td></tr></table>"
        "<h4>2026年1季度股票投资明细</h4><table></table>"
    )
    sections = reports.quarter_sections(spark.createDataFrame([(7, html)], "id INT, html STRING"))
    assert [(r["report_date"], r["report_period"]) for r in sections.orderBy("report_date").collect()] == [
        (date(2026, 3, 31), "2026年1季度股票投资明细"),
        (date(2026, 6, 29), "2026年2季度股票投资明细"),
    ]
    row = reports.holding_rows(sections).collect()
    assert len(row) == 1
    got = row[0]
    assert (got["asset_code"], got["asset_name"], got["sort_order"], got["market"]) == ("600519", "贵州&茅台", 1, "SH")
    assert (got["weight"], got["market_value"], got["share_quantity"]) == (pytest.approx(0.095), 1234.0, 12.5)


def test_odd_report_pages(spark):
    cell, title = "<td>{}</td>", "2026年1季度股票投资明细"
    row = "".join(map(cell.format, (" 1", "<b>00700</b>", "&nbsp;x&amp;lt; ", "", "--", "5", "1,000.5", "2%")))
    pages = [
        # An opening tag over a closing one, headings in headings, other headings, text between the cells.
        f"<h4 <h4>{title}</h4><tr></tr>y<tr a='1'>z{row}</tr><h4>other</h4><tr>\n{row}\n</tr></tr><tr {row}</tr><h4>{title}",
        f"<h4>a<h4>b{title}</h4>截止至： <font>2020-02-30</font><tr></tr><tr><td x</td>{row}</tr><trx>{row}</tr>",
        None, "", f"<h4>{title}",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "id INT, html STRING")
    sections = reports.quarter_sections(df)
    assert [(r["id"], r["report_date"], r["year"], r["quarter"]) for r in sections.orderBy("id").collect()] == [
        (0, date(2026, 3, 31), "2026", "1"), (1, date(2026, 3, 31), "2026", "1"),
    ]
    want = (1, "00700", "\xa0x&lt;", pytest.approx(0.02), 1000.5, 5.0)
    rows = reports.holding_rows(sections).orderBy("id").collect()
    names = ("sort_order", "asset_code", "asset_name", "weight", "market_value", "share_quantity")
    assert [r["id"] for r in rows if tuple(r[n] for n in names) == want] == [0, 0, 1]
    for text in (*filter(None, pages), "<td>a</td> <td>b<td>c</td><td>d", "x<td\ty>a</td>\n<tdx>b</td><td>c</td>"):
        assert [(m.start(), m.end(), m[1]) for m in reports.TITLE.finditer(text)] == reports.titles_of(text)
        for tag in ("tr", "td"):
            assert apply(spark, [text], lambda c, tag=tag: reports.elements(c, tag)) == [reports.inner_html(tag)(text)]


def test_report_cells_are_read_once(spark):
    df = spark.createDataFrame([(7, "")], "id INT, html STRING")
    plan = reports.holding_rows(reports.quarter_sections(df))._jdf.queryExecution().executedPlan().toString()
    # Neither matched again for the rows that have enough cells, nor dates tried that are not there.
    assert plan.count("</td>") < 2
    assert "gettimestamp" not in plan


def test_report_pages_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(feeds, "landed", lambda rows: rows)
    monkeypatch.setattr(skew, "TASK_ROWS", 500)
    pages = feeds.report_pages(Domain(spark, "/root/testdata/sf0.001"))
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert pages.rdd.getNumPartitions() == -(-rows // 500)


def test_mapping_keys(spark):
    df = spark.createDataFrame([('{"600519|SH": "白酒", "AAPL": "科技", "A|B|C": "x"}',)], "payload STRING")
    got = {tuple(r) for r in mappings.read_industry_mapping(df).collect()}
    assert got == {("600519", "SH", "白酒"), ("AAPL", "UNKNOWN", "科技"), ("A", "B|C", "x")}


def test_share_classes_need_two_letters(spark):
    rows = [
        (1, "医药A", "X", 2), (2, "医药C", "X", 3), (3, "医药", "X", 1),
        (4, "白酒A", "X", 1), (5, "白酒", "X", 1), (6, "医药A", "Y", 1),
    ]
    data = [(pid, name, inst) for pid, name, inst, n in rows for _ in range(n)]
    df = spark.createDataFrame(data, "product_id LONG, product_name STRING, institution_code STRING")
    got = {(r["kept_id"], r["merged_id"]) for r in holdings.share_class_map(df).collect()}
    assert got == {(2, 1), (2, 2), (2, 3), (4, 4), (5, 5), (6, 6)}


def test_industry_returns_equal_the_padded_grid(spark):
    days = pd.date_range("2026-01-01", periods=6).date
    prices = {
        "SH1": [10, 11, None, 12, 12, 13], "SH2": [None, 20, 21, None, None, 22],
        "SH3": [5, None, None, None, 6, 6], "SH4": [7, 8, 9, 10, 11, 12],
    }
    industry = {"SH1": "a", "SH2": "a", "SH3": "a", "SH4": "b"}
    rows = [(s, d, float(p), industry[s]) for s, ps in prices.items() for d, p in zip(days, ps) if p is not None]
    df = spark.createDataFrame(rows, "symbol_code STRING, quote_date DATE, close_price DOUBLE, industry STRING")
    got = returns.industry_returns(df, min_stocks=2, min_days=3).toPandas()
    grid = pd.DataFrame(prices, index=days, dtype=float).ffill().pct_change(fill_method=None)
    want = grid[["SH1", "SH2", "SH3"]].mean(axis=1).dropna()
    assert set(got.industry) == {"a"}
    assert dict(zip(got.quote_date, got.industry_return)) == pytest.approx(dict(want))


def test_correlation_of_a_constant_series_is_null(spark):
    rows = [(i, date(2026, 1, d), float(v)) for i, vs in {"a": [1, 2, 3, 5], "b": [2, 4, 6, 9], "c": [1, 1, 1, 1]}.items() for d, v in zip(range(1, 5), vs)]
    df = spark.createDataFrame(rows, "industry STRING, quote_date DATE, industry_return DOUBLE")
    corr = returns.correlation(df, min_periods=3)
    got = {(r["industry_a"], r["industry_b"]): r["corr"] for r in corr.collect()}
    assert got["a", "a"] == pytest.approx(1.0)
    assert got["a", "b"] == pytest.approx(pd.Series([1, 2, 3, 5]).corr(pd.Series([2, 4, 6, 9])))
    assert got["a", "c"] is None and got["c", "c"] is None


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(1.5,), (1.5,), (None,)], "v DOUBLE")
    assert [tuple(r) for r in timeseries.distance_histogram(df, "v").collect()] == [(0, "1.500", 2)]
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v DOUBLE")
    got = [r["count"] for r in timeseries.distance_histogram(df, "v", 5).orderBy("bin_index").collect()]
    assert got == [2, 2, 2, 2, 3]


def test_similarity_is_symmetric_and_keeps_zero_scores(spark):
    cells = [(1, "a", 0.5), (1, "b", 0.5), (2, "b", 0.2), (2, "c", 0.8), (3, "z", 1.0)]
    df = holdings.l2_normalised(spark.createDataFrame(cells, "product_id LONG, feature STRING, raw_weight DOUBLE"))
    for metric in similarity.METRICS:
        a = {r["product_id"]: r["score"] for r in similarity.neighbors(df, 1, metric).collect()}
        b = {r["product_id"]: r["score"] for r in similarity.neighbors(df, 2, metric).collect()}
        assert a[2] == pytest.approx(b[1])
        assert a[3] == 0.0
    assert similarity.neighbors(df, 1, "jaccard").first()["score"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        similarity.neighbors(df, 1, "euclid")
