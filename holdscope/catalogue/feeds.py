"""Queries: landed text feeds, built from the test tables and parsed back.

Each oracle states the expected values straight from the tables, without the text between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain, case, cents, sql
from holdscope.catalogue.registry import query, rounded
from holdscope.functions import constants as C
from holdscope.functions import text
from holdscope.operators.skew import width_of
from holdscope.session import cut_lineage
from holdscope.sources import mappings, products, quotes, reports


def landed(rows: DataFrame) -> DataFrame:
    """Text rows as a feed would leave them: written out before anything parses them."""
    return cut_lineage(rows)


def number_text(c: Column, scale: int = 2) -> Column:
    """Whole cents as plain decimal text."""
    return (c.cast("decimal(24,0)") / F.lit(10**scale)).cast(f"decimal(24,{scale})").cast("string")


# Klines: one line per line item. Line number 1 is cut short, 2 has no change.
def kline_lines(d: Domain) -> DataFrame:
    lines = d.spread(d.raw("lineitem"))
    value, number = cents("l_extendedprice"), F.col("l_linenumber")
    price = number_text(value)
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    change = F.when(number == 2, "-").otherwise(number_text(cents("l_tax")))
    volume = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".7"))
    head = F.concat_ws(",", day, price, price, number_text(value + 100), number_text(value - 100), volume)
    full = F.concat_ws(",", head, price, F.lit("1.5"), F.lit(" 2.25 "), change, F.lit("null"))
    joined = lines.join(d.parts(), lines["l_partkey"] == F.col("p_partkey"))
    return landed(
        joined.select(
            "asset_code",
            "market",
            "l_orderkey",
            F.when(number == 1, head).when(number == 3, F.concat(F.lit("bad day,"), full)).otherwise(full).alias("line"),
        )
    )


KLINE = """
    SELECT t.asset_code, t.market, l_orderkey, CAST(l_shipdate AS DATE) AS quote_date, v / 100 AS open_price,
        (v + 100) / 100 AS high_price, (v - 100) / 100 AS low_price, v / 100 AS close_price,
        CASE WHEN l_linenumber NOT IN (1, 2) THEN (v - x) / 100 END AS prev_close,
        CASE WHEN l_linenumber NOT IN (1, 2) THEN x / 100 END AS change_amount,
        CASE WHEN l_linenumber <> 1 THEN 2.25 END AS change_pct, CAST(l_quantity AS BIGINT) AS volume,
        CASE WHEN l_linenumber <> 1 THEN v / 100 END AS amount
    FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS v, CAST(round(l_tax * 100) AS BIGINT) AS x
          FROM lineitem WHERE l_linenumber <> 3) JOIN parts t ON p_partkey = l_partkey"""


@query(sql(KLINE, "parts"))
def parse_kline_lines(d: Domain) -> DataFrame:
    rows = quotes.parse_klines(kline_lines(d))
    return rows.withColumns({c: F.col(c).cast("double") for c in (*quotes.PRICES, "amount")})


@query(sql(f"""SELECT market || asset_code AS symbol_code, quote_date, close_price,
        CASE WHEN market = 'HK' THEN 'hk' ELSE 'domestic' END AS market_region,
        CASE WHEN market = 'HK' THEN 'HKD' ELSE 'CNY' END AS currency, 'share' AS volume_unit, 'stock' AS asset_class,
        CASE market WHEN 'SH' THEN '1' WHEN 'SZ' THEN '0' WHEN 'HK' THEN '128' WHEN 'BJ' THEN '1' END || '.' || asset_code
            AS source_code
    FROM ({KLINE}) WHERE market <> 'US' AND quote_date BETWEEN DATE '2001-06-30' - 60 AND DATE '2001-06-30'""", "parts"))
def stock_quote_rows(d: Domain) -> DataFrame:
    today = F.lit("2001-06-30").cast("date")
    rows = quotes.stock_quotes(quotes.in_collect_window(quotes.parse_klines(kline_lines(d)), today))
    return rows.select(
        "symbol_code", "quote_date", F.col("close_price").cast("double"), "market_region", "currency",
        "volume_unit", "asset_class", "source_code",
    )


# Live quote lines: one per event, in the layout of the event type's symbol.
LIVE = {"click": "sh000300", "error": "sz399006", "purchase": "rt_hkHSI", "signup": "gb_ixic", "view": "hf_GC"}


def live_lines(d: Domain) -> DataFrame:
    t, user = F.col("event_type"), F.col("user_id")
    price, prev = number_text(cents("value")), number_text(cents("value") + 250)
    day = F.date_format("ts", "yyyy-MM-dd")
    volume = F.concat(user.cast("string"), F.lit(".9"))
    stock = F.concat_ws(",", F.lit("name"), price, prev, price, price, F.lit("-"), F.lit("0"), F.lit("0"), volume, price, F.lit("x"), F.regexp_replace(day, "-", "/"), F.lit("15:00:00"))
    hk = F.concat_ws(",", F.lit("HSI"), F.lit("name"), price, prev, price, F.lit("null"), price, F.lit("0"), day, F.lit("16:00"))
    fill = F.lit(",".join(["0"] * 14))
    us = F.concat_ws(",", F.lit("name"), price, F.lit("1.5"), F.concat(day, F.lit(" 15:30:36")), F.lit("--"), price, price, F.lit("-"), F.lit("0"), F.lit("0"), volume, fill, prev)
    commodity = F.concat_ws(",", price, F.lit(""), F.lit("0"), F.lit("0"), price, price, F.lit("15:00"), prev, price, F.lit("0"), F.lit("0"), F.lit("0"), day, F.lit("gold"))
    body = F.when(t == "purchase", hk).when(t == "signup", us).when(t == "view", commodity).otherwise(stock)
    # Users of the last ten ids send empty or short lines.
    body = F.when(user % 50 == 0, "").when(user % 50 == 1, F.lit("a,b,c")).otherwise(body)
    line = F.concat(F.lit("var hq_str_"), case(t, LIVE), F.lit('="'), body, F.lit('";'))
    return landed(d.spread(d.raw("events")).select("event_id", line.alias("line")))


LIVE_ORACLE = """
    SELECT event_id, live_symbol, quote_date, p AS open_price, p AS high_price,
        CASE event_type WHEN 'view' THEN p END AS low_price, p AS close_price, b AS prev_close,
        CASE WHEN event_type = 'signup' THEN ((CAST(round(b * 100) AS BIGINT) * 15 + 5) // 10) / 10000 ELSE round(p - b, 4) END AS change_amount,
        CASE WHEN event_type = 'signup' THEN 1.5 ELSE round((p - b) / b * 100, 4) END AS change_pct,
        CASE WHEN event_type IN ('click', 'error', 'signup') THEN user_id END AS volume,
        CASE WHEN event_type IN ('click', 'error') THEN p END AS amount
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) / 100 AS p, (CAST(round(value * 100) AS BIGINT) + 250) / 100 AS b,
              CAST(ts AS DATE) AS quote_date,
              CASE event_type WHEN 'click' THEN 'sh000300' WHEN 'error' THEN 'sz399006' WHEN 'purchase' THEN 'rt_hkHSI'
                  WHEN 'signup' THEN 'gb_ixic' ELSE 'hf_GC' END AS live_symbol
          FROM events WHERE user_id % 50 NOT IN (0, 1))"""


def _live(d: Domain) -> DataFrame:
    return quotes.parse_quote_lines(live_lines(d), d.event_day())


@query(LIVE_ORACLE)
def parse_live_lines(d: Domain) -> DataFrame:
    rows = _live(d).withColumns({c: F.col(c).cast("double") for c in (*quotes.PRICES, "amount")})
    return rounded(rows, "change_amount", "change_pct", digits=4)


@query(sql(f"""SELECT s.symbol_code, s.volume_unit, count(*) AS quotes, min(quote_date) AS first_date,
        max(quote_date) AS last_date
    FROM ({LIVE_ORACLE}) q JOIN (VALUES {", ".join(f"('{s[0]}', '{s[5]}', '{s[7]}')" for s in C.MARKET_SYMBOLS)})
        s(symbol_code, live_symbol, volume_unit) USING (live_symbol) GROUP BY 1, 2"""))
def live_quotes_with_symbol(d: Domain) -> DataFrame:
    rows = quotes.with_symbol(_live(d), quotes.symbol_table(d.spark), "live_symbol")
    return rows.groupBy("symbol_code", "volume_unit").agg(
        F.count(F.lit(1)).alias("quotes"), F.min("quote_date").alias("first_date"), F.max("quote_date").alias("last_date")
    )


@query(sql("""SELECT symbol_code, quote_date, close_price FROM market_quotes WHERE asset_class <> 'commodity'
    UNION ALL SELECT symbol_code, quote_date, close_price + 1 FROM market_quotes WHERE asset_class = 'commodity'""",
           "market_quotes"))
def primary_or_fallback(d: Domain) -> DataFrame:
    q = d.market_quotes().select("symbol_code", "quote_date", "close_price", "asset_class")
    primary = q.filter("asset_class <> 'commodity'").drop("asset_class")
    fallback = q.drop("asset_class").withColumn("close_price", F.col("close_price") + 1)
    return quotes.primary_or_fallback(primary, fallback)


@query(sql(f"""SELECT w.symbol_code, q.source, q.a AS quote_date_min, q.z AS quote_date_max,
        CASE WHEN q.z IS NULL THEN 'failed' ELSE 'success' END AS status
    FROM (VALUES {", ".join(f"('{s[0]}')" for s in C.MARKET_SYMBOLS)}) w(symbol_code)
    LEFT JOIN (SELECT symbol_code, min(symbol_name) AS source, min(quote_date) AS a, max(quote_date) AS z
               FROM market_quotes GROUP BY 1) q USING (symbol_code)""", "market_quotes"))
def symbol_status(d: Domain) -> DataFrame:
    seen = d.market_quotes().withColumn("data_source", F.col("symbol_name"))
    return quotes.symbol_status(quotes.symbol_table(d.spark), seen)


# HTML.
@query(sql(r"""
    SELECT page_id, CAST(i - 1 AS INTEGER) AS position, replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(items[i], '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS item
    FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS items FROM pages))"""))
def html_list_items(d: Domain) -> DataFrame:
    rows = d.raw("pages").select("page_id", F.posexplode(reports.elements(F.col("html"), "li")).alias("position", "i"))
    return rows.select("page_id", "position", reports.plain(F.col("i")).alias("item"))


def report_pages(d: Domain) -> DataFrame:
    """One page per order with a section per quarter and a table row per line item.

    Line items are dealt by order before they become text, as many to a task as the counted rows ask for.
    """
    lines = d.raw("lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_discount", "l_quantity", "l_extendedprice")
    joined = lines.join(d.parts().select("p_partkey", "p_name", "asset_code"), F.col("l_partkey") == F.col("p_partkey"))
    dealt = joined.repartition(width_of(d.spark, lines.count()), "l_orderkey")

    def td(*parts: Column) -> Column:
        return F.concat(F.lit("<td class='x'>"), *parts, F.lit("</td>"))

    # The code is padded so that rows sort by part.
    row = F.concat(
        F.lit("<tr>"),
        td(F.lit("7")),
        td(F.lit("<a href='#'>"), F.col("asset_code"), F.lit("</a>")),
        td(F.lit(" "), F.col("p_name"), F.lit(" &amp; co ")),
        td(F.lit("")),
        td(cents("l_discount").cast("string"), F.lit(".00%")),
        td(F.format_number("l_quantity", 2)),
        td(F.format_number("l_extendedprice", 2)),
        F.lit("</tr>"),
    )
    y, q = F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string")
    end = F.date_format(reports.quarter_end(y, q), "yyyy-MM-dd")
    stated = F.when(F.quarter("l_shipdate") % 2 == 1, F.concat(F.lit("截止至： <font class='px12'>"), end, F.lit("</font>")))
    head = F.concat(
        F.lit("<h4 class='t'><label>Fund "), y, F.lit("年"), q, F.lit("季度股票投资明细</label></h4>"),
        F.coalesce(stated, F.lit("")),
        F.lit("<table><tr><th>no</th><td>header</td></tr>"),
    )
    # Sections come in the order of their heads, rows in that of their text; a head stands before its first row alone.
    pages = dealt.select("l_orderkey", F.when(head.isNotNull(), F.struct(head.alias("head"), row.alias("row"))).alias("line"))
    pages = pages.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))

    def with_head(line: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        begin = F.concat(F.when(i > 0, "</table>").otherwise(""), line["head"])
        start = F.when((i == 0) | (before["head"] != line["head"]), begin).when(before["row"].isNull(), "").otherwise("\n")
        return F.concat(start, F.coalesce(line["row"], F.lit("")))

    text = F.array_join(F.transform("lines", with_head), "")
    foot = F.when(F.size("lines") > 0, "</table>").otherwise("")
    return landed(pages.select("l_orderkey", F.concat(F.lit("<html>head "), text, foot).alias("html")))


SECTION_ROWS = """
    SELECT l_orderkey, CAST(y AS VARCHAR) || '年' || CAST(q AS VARCHAR) || '季度股票投资明细' AS report_period,
        last_day(make_date(CAST(y AS INTEGER), CAST(q * 3 AS INTEGER), 1)) AS report_date, 7 AS sort_order,
        asset_code, p_name || ' & co' AS asset_name, CAST(round(l_discount * 100) AS BIGINT) / 100 AS weight,
        l_quantity AS share_quantity, l_extendedprice AS market_value,
        CASE WHEN regexp_matches(asset_code, '^(60|68|51|52|53)') THEN 'SH'
            WHEN regexp_matches(asset_code, '^(00|30|39|12|08)') THEN 'SZ'
            WHEN regexp_matches(asset_code, '^(8|4|43)') THEN 'BJ' WHEN length(asset_code) = 5 THEN 'HK'
            ELSE 'UNKNOWN' END AS market
    FROM (SELECT *, year(l_shipdate) AS y, quarter(l_shipdate) AS q FROM lineitem) JOIN parts ON p_partkey = l_partkey"""


@query(sql(SECTION_ROWS, "parts"))
def parse_report_html(d: Domain) -> DataFrame:
    sections = reports.quarter_sections(report_pages(d)).drop("year", "quarter")
    rows = reports.holding_rows(sections)
    return rounded(rows, "weight").select(
        "l_orderkey", "report_period", "report_date", "sort_order", "asset_code", "asset_name", "weight",
        "share_quantity", "market_value", "market",
    )


def quarterly_holdings(d: Domain) -> DataFrame:
    """Holdings of suppliers per shipping quarter; the share of the quarter is the weight."""
    return d.raw("lineitem").groupBy(
        F.col("l_suppkey").alias("product_id"),
        F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("report_date"),
        F.col("l_partkey").alias("asset"),
    ).agg(
        (F.sum(cents("l_discount")) / F.lit(1000)).alias("weight"),
        (F.sum(cents("l_extendedprice")) / F.lit(100)).alias("market_value"),
    )


QUARTERS = ("quarters", """
    SELECT * FROM (SELECT *, max(report_date) OVER (PARTITION BY product_id) AS md FROM (
        SELECT l_suppkey AS product_id, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS report_date,
            l_partkey AS asset, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / 1000 AS weight,
            CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) / 100 AS market_value
        FROM lineitem GROUP BY 1, 2, 3)) WHERE report_date = md""")


@query(sql("""SELECT product_id, report_date, 'stock' AS asset_class, round(sum(weight), 6) AS weight,
    round(sum(market_value), 2) AS market_value FROM quarters GROUP BY 1, 2""", extra=(QUARTERS,)))
def allocation_of_latest_quarter(d: Domain) -> DataFrame:
    return rounded(rounded(reports.allocation_rows(quarterly_holdings(d)), "weight"), "market_value", digits=2)


@query(sql("""SELECT product_id, report_date, round(sum(weight), 6) AS top10_weight, round(sum(weight), 6) AS stock_weight,
    count(*) AS holding_count, round(sum(weight * weight), 6) AS concentration_score FROM quarters GROUP BY 1, 2""",
           extra=(QUARTERS,)))
def summary_of_latest_quarter(d: Domain) -> DataFrame:
    rows = reports.summary_rows(quarterly_holdings(d))
    return rounded(rows, "top10_weight", "stock_weight", "concentration_score")


@query(sql("""SELECT p.o_custkey, last_day(make_date(CAST(p.y AS INTEGER) - g.b, q.m, 1)) AS report_date
    FROM (SELECT o_custkey, max(year(o_orderdate)) AS y FROM orders GROUP BY 1) p,
        (VALUES (0), (1), (2)) g(b), (VALUES (3), (6), (9), (12)) q(m)"""))
def quarter_dates(d: Domain) -> DataFrame:
    """Quarter ends of the three years up to each customer's last order."""
    last = d.raw("orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("y"))
    return reports.report_dates(last, F.col("y")).select("o_custkey", "report_date")


# Product lists.
NAMES = ("天天现金宝", "固收增强债", "混合优选", "权益精选股票", "沪深指数ETF", "全球qdii", "商品衍生", "养老fof", "普通封闭", "丰利稳富", "货币余额宝", "智富")
RAWS = ("固收类", "001", "混合", "权益", "货币", "指数", "每日购", "现金", "商品", "003", "")
RISKS = ("R1", "低风险", "中低风险", "R2", "中高风险", "较高风险", "高风险", "r4", "PR5", "三级", "五级", "", "R3")


def pick(words: tuple[str, ...]) -> Column:
    i = F.col("c_custkey") % len(words) + 1
    return F.element_at(F.array(*[F.lit(w) for w in words]), i.cast("int"))


def pick_sql(words: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(w) for w in words)}][CAST(c_custkey % {len(words)} + 1 AS INTEGER)]"


def feed_rows(d: Domain, source: str) -> DataFrame:
    """A JSON object per customer in the field names of a source; two customers share a code."""
    by_name = {
        "product_code": F.concat(F.lit("K"), F.floor(F.col("c_custkey") / 2).cast("string")),
        "product_name": F.concat(pick(NAMES), F.col("c_custkey").cast("string")),
        "product_type_raw": pick(RAWS),
        "risk_text": pick(RISKS),
        "unit_nav": F.concat(number_text(cents("c_acctbal")), F.lit("")),
        "min_purchase_amount": F.lit("1,000.5"),
        "nav_date": F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), F.col("c_nationkey")), "yyyyMMdd"),
        "establish_date": F.lit("2001/02/03"),
        "maturity_date": F.when(F.col("c_nationkey") % 2 == 0, "2005-06-07").otherwise("长期"),
        "cumulative_nav": number_text(cents("c_acctbal")),
        "min_additional_amount": F.when(F.col("c_nationkey") % 3 != 0, "200").otherwise("--"),
        "currency": F.when(F.col("c_nationkey") % 4 != 0, "USD").otherwise(""),
        "performance_benchmark": F.when(F.col("c_nationkey") % 5 != 0, F.concat(F.lit("LPR+"), F.col("c_nationkey").cast("string"))).otherwise(""),
        "org_name": F.when(F.col("c_nationkey") < 20, "光大理财有限责任公司").otherwise("other"),
        "product_status": F.when(F.col("c_nationkey") == 3, "终止").otherwise("存续"),
    }
    fields: dict[str, Column] = {}
    for c, (_, f) in products.FIELDS[source].items():
        # Where two columns read one field, it has the first one's value.
        fields.setdefault(f, by_name[c] if c in by_name else F.concat(F.lit(f"{c} "), F.col("c_custkey").cast("string")))
    obj = F.struct(*[v.alias(f) for f, v in fields.items()])
    return d.raw("customer").select(
        F.col("c_custkey").alias("arrival"),
        F.to_json(obj).alias("payload"),
        F.lit("feed").alias("data_source"),
        F.lit("2002-01-01").cast("date").alias("collect_date"),
    )


def any_word(column: str, words: tuple[str, ...]) -> list[str]:
    return [f"contains({column}, '{w}')" for w in words]


def type_case(source: str, has_raw: bool) -> str:
    whens = []
    for kind, in_name, in_raw, in_upper in C.TYPE_RULES[source]:
        tests = any_word("name", in_name) + any_word("upper(name)", in_upper)
        tests += any_word("raw", in_raw) if has_raw else []
        if tests:
            whens.append(f"WHEN {' OR '.join(tests)} THEN '{kind}'")
    codes = [f"WHEN raw = '{k}' THEN '{v}'" for k, v in C.TYPE_CODES.get(source, {}).items()] if has_raw else []
    return f"CASE {' '.join(codes + whens)} ELSE 'other' END"


def risk_case(source: str, column: str) -> str:
    whens = [
        f"WHEN {' OR '.join(any_word(f'upper({column})', words))} THEN '{level}'"
        for level, words in C.RISK_RULES[source]
    ]
    return f"CASE WHEN {column} = '' THEN 'R3' {' '.join(whens)} ELSE 'R3' END"


def standard_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{w}' THEN '{level}'" for w, level in C.RISK_LEVELS.items()) + " END"


def feed_sql(source: str) -> str:
    fields = products.FIELDS[source]
    first = source in ("CEB", "CITIC", "ZY")
    raw_risk = {"JX": "CASE WHEN risk = '' THEN 'R3' ELSE risk END", "SPD": "CASE WHEN risk = '' THEN 'R3' ELSE risk END"}.get(
        source, risk_case(source, "risk") if source in C.RISK_RULES else "'R3'"
    )
    fallback = {
        "JX": "CASE WHEN regexp_matches(upper(rl), '^R[1-5]$') THEN 'L' || substr(rl, 2) ELSE 'L3' END",
        "SPD": risk_case("SPD", "rl") if source == "SPD" else "rl",
    }.get(source, "rl")
    null = "CAST(NULL AS VARCHAR)"

    def given(column: str, value: str, otherwise: str = null) -> str:
        return value if column in fields else otherwise

    code = "'K' || CAST(c_custkey // 2 AS VARCHAR)"
    registration = code if source in ("BOC", "CITIC", "CEB") else given("registration_code", "'registration_code ' || c_custkey")
    benchmark = "CASE WHEN c_nationkey % 5 <> 0 THEN 'LPR+' || c_nationkey {} END".format("" if source == "ZY" else "ELSE ''")
    sub_type = "'product_sub_type ' || c_custkey" if source == "CITIC" else given("product_type_raw", "nullif(raw, '')")
    kind, institution, custodian = C.INSTITUTIONS[source]
    columns = {
        "institution_type": f"'{kind}'",
        "institution_name": f"'{institution}'",
        "institution_code": f"'{source}'",
        "product_code": code,
        "product_name": "name",
        "product_short_name": given("product_short_name", "'product_short_name ' || c_custkey") if source != "ZY" else null,
        "product_type": type_case(source, "product_type_raw" in fields),
        "product_sub_type": sub_type,
        "registration_code": registration,
        "sales_code": null,
        "establish_date": given("establish_date", "DATE '2001-02-03'", "CAST(NULL AS DATE)"),
        "maturity_date": given("maturity_date", "CASE WHEN c_nationkey % 2 = 0 THEN DATE '2005-06-07' END", "CAST(NULL AS DATE)"),
        "risk_level": raw_risk,
        "currency": given("currency", "CASE WHEN c_nationkey % 4 <> 0 THEN 'USD' ELSE 'CNY' END", "'CNY'"),
        "manager": f"'{institution}'",
        "custodian": f"'{custodian}'" if custodian else null,
        "fund_manager": null,
        "investment_target": null,
        "investment_scope": null,
        "investment_strategy": null,
        "performance_benchmark": given("performance_benchmark", benchmark),
        "benchmark_type": null,
        "min_purchase_amount": given("min_purchase_amount", "1000.5", "CAST(NULL AS DOUBLE)"),
        "min_additional_amount": given("min_additional_amount", "CASE WHEN c_nationkey % 3 <> 0 THEN 200.0 END", "CAST(NULL AS DOUBLE)"),
        "status": "CASE WHEN c_nationkey = 3 THEN 'inactive' ELSE 'active' END" if source == "SPD" else "'active'",
        "data_source": "'feed'",
        "collect_date": "DATE '2002-01-01'",
        "unit_nav": given("unit_nav", "c_acctbal", "CAST(NULL AS DOUBLE)"),
        "cumulative_nav": given("cumulative_nav", "c_acctbal", "CAST(NULL AS DOUBLE)"),
        "nav_date": given("nav_date", "DATE '2001-01-01' + CAST(c_nationkey AS INTEGER)", "CAST(NULL AS DATE)"),
    }
    inner = ", ".join(f"{v} AS {c}" for c, v in columns.items())
    return f"""
    SELECT * EXCLUDE (rn), coalesce({standard_case("risk_level")}, {fallback.replace("rl", "risk_level")}) AS risk_level_standard
    FROM (SELECT {inner}, row_number() OVER (PARTITION BY c_custkey // 2 ORDER BY c_custkey) AS rn
          FROM (SELECT *, {pick_sql(NAMES)} || CAST(c_custkey AS VARCHAR) AS name, {pick_sql(RAWS)} AS raw,
                    {pick_sql(RISKS)} AS risk FROM customer
                {"WHERE c_nationkey < 20" if source == "CEB" else ""}))
    {"WHERE rn = 1" if first else ""}"""


def _feed(source: str) -> None:
    @query(feed_sql(source), f"product_feed_{source.lower()}")
    def run(d: Domain) -> DataFrame:
        """All unified columns, and the feed's own value columns beside them."""
        rows = products.bank_rows(feed_rows(d, source), source)
        extra = [
            (F.col(c) if c in rows.columns else F.lit(None).cast(t)).alias(c)
            for c, t in (("unit_nav", "double"), ("cumulative_nav", "double"), ("nav_date", "date"))
        ]
        wide = products.normalise(rows, source)
        joined = rows.select("product_code", F.coalesce("product_name", F.lit("")).alias("product_name"), *extra)
        amounts = {c: F.col(c).cast("double") for c in ("min_purchase_amount", "min_additional_amount")}
        return wide.join(joined, ["product_code", "product_name"]).withColumns(amounts)


for _source in products.FIELDS:
    _feed(_source)


NO_TEXT = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in (
    "product_short_name", "registration_code", "sales_code", "custodian", "fund_manager", "investment_target",
    "investment_scope", "investment_strategy", "performance_benchmark", "benchmark_type"))


@query(f"""SELECT 'fund_company' AS institution_type, '广发基金' AS institution_name, 'GF' AS institution_code,
        '广发基金' AS manager, 'F' || CAST(c_custkey AS VARCHAR) AS product_code, name AS product_name,
        {type_case("fund", False)} AS product_type, '混合型' AS product_sub_type, {NO_TEXT},
        CAST(NULL AS DATE) AS establish_date, CAST(NULL AS DATE) AS maturity_date, 'R3' AS risk_level,
        'L3' AS risk_level_standard, 'CNY' AS currency, CAST(NULL AS DOUBLE) AS min_purchase_amount,
        CAST(NULL AS DOUBLE) AS min_additional_amount, 'active' AS status, 'feed' AS data_source,
        DATE '2002-01-01' AS collect_date, c_acctbal AS unit_nav, CAST(NULL AS DOUBLE) AS cumulative_nav,
        1.25 AS daily_return, 1.0 AS return_1m, 2.0 AS return_3m, CASE WHEN c_custkey % 2 = 0 THEN 3.0 END AS return_6m,
        CASE WHEN c_custkey % 2 = 0 THEN 12.5 END AS return_1y
    FROM (SELECT *, {pick_sql(NAMES)} AS name FROM customer WHERE c_custkey % 3 <> 2)""")
def product_feed_funds(d: Domain) -> DataFrame:
    """Fund list arrays; every third customer's array is too short."""
    key = F.col("c_custkey")

    def quoted(*cells: Column) -> list[Column]:
        return [F.concat(F.lit('"'), c, F.lit('"')) for c in cells]

    head = quoted(
        F.concat(F.lit("F"), key.cast("string")), pick(NAMES), F.lit("混合型"), F.lit(""), F.lit("x"),
        number_text(cents("c_acctbal")), F.lit("---"),
    )
    tail = quoted(F.lit("1.25"), F.lit(""), F.lit(""), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("12.5"))
    short = F.concat_ws(",", *head)
    cells = F.when(key % 3 == 2, short).when(key % 2 == 0, F.concat_ws(",", *head, *tail)).otherwise(
        F.concat_ws(",", *head, *tail[:5])
    )
    lists = d.raw("customer").select(
        F.concat(F.lit("[["), cells, F.lit("]]")).alias("payload"),
        F.lit("feed").alias("data_source"),
        F.lit("2002-01-01").cast("date").alias("collect_date"),
    )
    rows = products.fund_rows(lists)
    wide = products.normalise(rows, "fund", "GF")
    values = ["unit_nav", "cumulative_nav", "daily_return", "return_1m", "return_3m", "return_6m", "return_1y"]
    amounts = {c: F.col(c).cast("double") for c in ("min_purchase_amount", "min_additional_amount")}
    return wide.join(rows.select("product_code", *values), "product_code").withColumns(amounts)


@query("""SELECT c.c_custkey AS arrival, 'K' || CAST(c.c_custkey AS VARCHAR) AS product_code, n.o_totalprice AS unit_nav,
        CAST(n.o_orderdate AS DATE) AS nav_date
    FROM customer c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
        FROM orders WHERE o_orderdate >= DATE '2001-01-01') WHERE rn = 1) n ON n.o_custkey = c.c_custkey""")
def products_with_first_nav(d: Domain) -> DataFrame:
    """Product list and NAV list of one source, landed apart."""
    code = F.lit("K")
    listed = d.raw("customer").select(
        F.col("c_custkey").alias("arrival"), F.concat(code, F.col("c_custkey").cast("string")).alias("product_code")
    )
    o = d.raw("orders").filter(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    obj = F.struct(
        F.concat(code, F.col("o_custkey").cast("string")).alias("REAL_PRD_CODE"),
        number_text(cents("o_totalprice")).alias("NAV"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ISS_DATE"),
    )
    landed = o.select(F.col("o_orderkey").alias("arrival"), F.to_json(obj).alias("payload"))
    navs = products.picked_fields(landed, products.SPD_NAV_FIELDS, first_ten=False)
    return products.with_first_nav(listed, navs).select("arrival", "product_code", "unit_nav", "nav_date")


@query(sql("""SELECT 'feed_a' AS feed, product_id, product_type FROM products WHERE product_type = 'equity'
    UNION ALL SELECT 'feed_b', product_id, product_type FROM products WHERE product_type <> 'equity'""", "products"))
def concatenated_feeds(d: Domain) -> DataFrame:
    p = d.products().select("product_id", "product_type")
    a = p.filter("product_type = 'equity'").withColumn("feed", F.lit("feed_a"))
    return a.unionByName(p.filter("product_type <> 'equity'").withColumn("feed", F.lit("feed_b")))


# Mapping files.
@query(sql("""SELECT asset_code, CASE WHEN p_size % 5 = 0 THEN 'UNKNOWN' ELSE market END AS market, p_brand AS industry_name
    FROM parts""", "parts"))
def read_industry_mapping(d: Domain) -> DataFrame:
    key = F.when(F.col("p_size") % 5 == 0, F.col("asset_code")).otherwise(F.concat_ws("|", "asset_code", "market"))
    landed = d.parts().select(F.to_json(F.create_map(key, F.col("p_brand"))).alias("payload"))
    return mappings.read_industry_mapping(landed)


@query(sql("""SELECT '{"' || asset_code || '|' || market || '":"' || industry_name || '"}' AS value FROM securities
    WHERE industry_name IS NOT NULL""", "securities"))
def write_industry_mapping(d: Domain) -> DataFrame:
    return mappings.industry_mapping_lines(d.securities().filter(F.col("industry_name").isNotNull()))


@query(sql("""SELECT '000300' AS index_code, '沪深300' AS index_name,
        CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 6 THEN CAST(p_partkey AS VARCHAR)
            ELSE lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS constituent_code, p_name AS constituent_name,
        CASE p_size % 4 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' WHEN 2 THEN 'BJ' ELSE 'UNKNOWN' END AS market,
        CASE WHEN p_size <> 9 THEN p_size / 100.0 END AS weight,
        CASE WHEN p_size <> 8 THEN DATE '2001-06-29' END AS effective_date FROM part"""))
def index_weight_file(d: Domain) -> DataFrame:
    size = F.col("p_size")
    blank = F.lit("")
    names = [f"col{i}" for i in range(10)]
    exchange = case(size % 4, {0: "上海证券交易所", 1: "深圳分所", 2: "北京证券交易所"}, F.lit("Other"))
    columns = [
        F.when(size == 8, "n/a").otherwise("20010629"), F.lit(" 300 "), F.lit("CSI"), blank,
        F.col("p_partkey").cast("string"), F.col("p_name"), blank, exchange, blank,
        F.when(size == 9, "-").otherwise(size.cast("string")),
    ]
    rows = d.raw("part").select(*[c.alias(n) for c, n in zip(columns, names)])
    return mappings.index_weight_rows(rows, names)


@query(sql(r"""SELECT p_partkey, regexp_replace(name, '\s*(Ⅱ|III|II|I|1|2|3)$', '') AS short,
        CASE WHEN name IN ('银行Ⅱ', '银行') THEN '银行业' ELSE regexp_replace(name, '\s*(Ⅱ|III|II|I)$', '') END AS report_short
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_brand || 'Ⅱ' WHEN 1 THEN p_brand WHEN 2 THEN p_name || ' III'
        WHEN 3 THEN '银行Ⅱ' ELSE p_name || ' I' END AS name FROM part)"""))
def shortened_industries(d: Domain) -> DataFrame:
    size, brand, name = F.col("p_size") % 5, F.col("p_brand"), F.col("p_name")
    full = (
        F.when(size == 0, F.concat(brand, F.lit("Ⅱ")))
        .when(size == 1, brand)
        .when(size == 2, F.concat(name, F.lit(" III")))
        .when(size == 3, "银行Ⅱ")
        .otherwise(F.concat(name, F.lit(" I")))
    )
    return d.raw("part").select(
        "p_partkey", text.shorten_industry(full).alias("short"), text.shorten_industry_report(full).alias("report_short")
    )
