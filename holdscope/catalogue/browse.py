"""Queries: snapshots, search pages, menus, dashboards and collection reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain, sql
from holdscope.catalogue.registry import query, rounded
from holdscope.functions import constants as C
from holdscope.functions import parsing, text
from holdscope.operators import browse, latest, reports
from holdscope.sources import quotes as quote_feed
from holdscope.sources.tables import as_json, run_sql

LATEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_code, product_code
        ORDER BY collect_date DESC, product_id DESC) AS rn FROM snapshots) WHERE rn = 1"""

# Advice words and symbol names as VALUES lists for the oracles.
SYMBOL_VALUES = ", ".join(f"('{s[0]}')" for s in C.MARKET_SYMBOLS)


@query(sql(f"SELECT product_id, institution_code, product_code, collect_date FROM ({LATEST})", "snapshots"))
def latest_snapshot_per_product(d: Domain) -> DataFrame:
    return latest.latest_snapshot(d.snapshots()).select(
        "product_id", "institution_code", "product_code", "collect_date"
    )


@query(sql(f"SELECT institution_code, count(*) AS count FROM ({LATEST}) GROUP BY 1", "snapshots"))
def latest_count_by_institution(d: Domain) -> DataFrame:
    return reports.count_by(latest.latest_snapshot(d.snapshots()), "institution_code")


@query(sql("""
    SELECT product_id, nav_date, unit_nav FROM (SELECT *, row_number() OVER (
        PARTITION BY product_id ORDER BY nav_date DESC, id DESC) AS rn FROM fund_nav) WHERE rn = 1""", "fund_nav"))
def latest_nav_per_product(d: Domain) -> DataFrame:
    return latest.latest_value(d.fund_nav(), "product_id", "nav_date", ["unit_nav"], "id")


@query(sql(f"""
    SELECT l.institution_code, count(*) AS total, count(n.product_code) AS with_nav,
        count(h.product_code) AS with_holding
    FROM ({LATEST}) l
    LEFT JOIN (SELECT DISTINCT institution_code, product_code FROM snapshots
               WHERE product_id IN (SELECT product_id FROM snapshot_nav)) n
        ON n.institution_code = l.institution_code AND n.product_code = l.product_code
    LEFT JOIN (SELECT DISTINCT institution_code, product_code FROM snapshots
               WHERE product_id IN (SELECT product_id FROM snapshot_reports)) h
        ON h.institution_code = l.institution_code AND h.product_code = l.product_code
    GROUP BY 1""", "snapshots", "snapshot_nav", "snapshot_reports"))
def coverage_by_institution(d: Domain) -> DataFrame:
    return reports.coverage(d.snapshots(), d.snapshot_nav(), d.snapshot_reports())


PRODUCT_HITS = """
    SELECT s.product_id, s.institution_code, s.product_code, s.product_name, s.product_type,
        s.risk_level_standard, s.status, n.nav_date, n.unit_nav
    FROM snapshots s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
        ORDER BY nav_date DESC, id DESC) AS rn FROM snapshot_nav) WHERE rn = 1) n ON n.product_id = s.product_id
    WHERE s.product_type = 'equity' AND s.status = 'active'
        AND (s.product_code ILIKE '%c1%' OR s.product_name ILIKE '%c1%')"""


def _product_hits(d: Domain) -> DataFrame:
    return browse.search_products(
        d.snapshots(), d.snapshot_nav(), product_type="equity", status="active", keyword=" c1 "
    )


@query(sql(f"""{PRODUCT_HITS} ORDER BY s.institution_code, s.product_code, s.product_id LIMIT 40 OFFSET 40""",
           "snapshots", "snapshot_nav"))
def product_search_page(d: Domain) -> DataFrame:
    order = [F.col("institution_code"), F.col("product_code"), F.col("product_id")]
    return browse.page(_product_hits(d), order, 2, 40)


@query(sql(f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 40)) AS BIGINT) AS pages
    FROM ({PRODUCT_HITS})""", "snapshots", "snapshot_nav"))
def product_search_total(d: Domain) -> DataFrame:
    return browse.page_total(_product_hits(d), 40)


HOLDING_HITS = """
    SELECT h.product_id, p.institution_code, p.product_code, h.report_date, r.report_period, h.asset_code,
        h.asset_name, h.asset_type, h.market, round(h.weight, 6) AS weight, h.weight AS w,
        h.market_value, h.share_quantity, h.sort_order
    FROM holdings h JOIN products p ON p.product_id = h.product_id
    LEFT JOIN (SELECT product_id AS report_id, 'annual' AS report_period FROM products
               WHERE status = 'active') r ON r.report_id = h.report_id
    WHERE h.asset_type = 'stock' AND h.market = 'SH' AND h.is_top10 AND h.weight >= 0.0005
        AND (h.asset_code ILIKE '%1%' OR h.asset_name ILIKE '%1%' OR h.industry_name ILIKE '%1%')"""


def _holding_hits(d: Domain) -> DataFrame:
    periods = d.products().filter("status = 'active'").select(
        F.col("product_id").alias("report_id"), F.lit("annual").alias("report_period")
    )
    return browse.search_holdings(
        d.holdings(), d.products(), periods, asset_type="stock", market="SH", keyword="1",
        min_weight_percent=0.05, only_top10=True,
    )


@query(sql(f"""SELECT * EXCLUDE (w) FROM ({HOLDING_HITS})
    ORDER BY w DESC NULLS LAST, report_date DESC, sort_order ASC NULLS LAST, product_id, asset_code
    LIMIT 25""", "holdings", "products"))
def holdings_search_page(d: Domain) -> DataFrame:
    page = browse.page(_holding_hits(d), browse.holding_order(), 1, 500)
    return rounded(page, "weight").select(
        "product_id", "institution_code", "product_code", "report_date", "report_period", "asset_code",
        "asset_name", "asset_type", "market", "weight", "market_value", "share_quantity", "sort_order",
    )


@query(sql(f"""SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS pages
    FROM ({HOLDING_HITS})""", "holdings", "products"))
def holdings_search_total(d: Domain) -> DataFrame:
    return browse.page_total(_holding_hits(d))


@query(sql("""SELECT product_code, institution_code, product_name, count(*) OVER () > 30 AS truncated FROM products
    ORDER BY product_name, product_id LIMIT 30""", "products"))
def products_capped(d: Domain) -> DataFrame:
    rows = browse.capped(d.products(), [F.col("product_name"), F.col("product_id")], 30)
    return rows.select("product_code", "institution_code", "product_name", "truncated")


@query(sql("""SELECT asset_code, asset_name, asset_type, market, sort_order, round(weight, 6) AS weight FROM holdings
    WHERE report_id = (SELECT report_id FROM holdings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        AND asset_type = 'stock' AND is_top10""", "holdings"))
def report_holdings_list(d: Domain) -> DataFrame:
    h = d.holdings()
    largest = h.groupBy("report_id").count().orderBy(F.col("count").desc(), "report_id").limit(1)
    rows = browse.report_holdings(h, largest.select("report_id").scalar(), "stock", only_top10=True)
    return rounded(rows, "weight").select("asset_code", "asset_name", "asset_type", "market", "sort_order", "weight")


@query(sql("""SELECT h.product_id, h.asset_code, h.market, s.asset_name AS security_name,
        s.industry_name AS security_industry
    FROM holdings h LEFT JOIN securities s ON s.asset_code = h.asset_code AND s.market = coalesce(h.market, 'UNKNOWN')""",
           "holdings", "securities"))
def holdings_with_security(d: Domain) -> DataFrame:
    return browse.with_security(d.holdings(), d.securities()).select(
        "product_id", "asset_code", "market", "security_name", "security_industry"
    )


@query(sql("""SELECT 'institution' AS menu, institution_code AS value FROM snapshots
    UNION SELECT 'status', status FROM snapshots
    UNION SELECT 'asset_type', asset_type FROM holdings
    UNION ALL SELECT 'report_date', CAST(report_date AS VARCHAR) FROM (
        SELECT DISTINCT report_date FROM snapshot_reports ORDER BY 1 DESC LIMIT 12)
    UNION ALL SELECT 'market_date', CAST(quote_date AS VARCHAR) FROM (
        SELECT DISTINCT quote_date FROM market_quotes ORDER BY 1 DESC LIMIT 30)""",
           "snapshots", "holdings", "snapshot_reports", "market_quotes"))
def filter_menus(d: Domain) -> DataFrame:
    menus = (
        ("institution", d.snapshots(), "institution_code", None, False),
        ("status", d.snapshots(), "status", None, False),
        ("asset_type", d.holdings(), "asset_type", None, False),
        ("report_date", d.snapshot_reports(), "report_date", 12, True),
        ("market_date", d.market_quotes(), "quote_date", 30, True),
    )
    out = None
    for name, df, column, limit, newest in menus:
        part = browse.menu(df, column, limit, newest).select(
            F.lit(name).alias("menu"), F.col(column).cast("string").alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("""
    SELECT product_id, asset_code,
        CASE asset_type WHEN 'stock' THEN '股票' WHEN 'bond' THEN '债券' ELSE asset_type END AS asset_label,
        CASE market WHEN 'SH' THEN '上海' WHEN 'SZ' THEN '深圳' WHEN 'BJ' THEN '北京' WHEN 'HK' THEN '港股'
            WHEN 'US' THEN '美股' ELSE '—' END AS market_label,
        CASE WHEN abs(v) >= 100000000 THEN CAST(CAST(v / 100000000 AS DECIMAL(30, 2)) AS VARCHAR) || '亿'
            WHEN abs(v) >= 10000 THEN CAST(CAST(round(v / 10000, 2) AS DECIMAL(30, 2)) AS VARCHAR) || '万'
            ELSE CAST(CAST(v AS DECIMAL(30, 2)) AS VARCHAR) END AS money,
        format('{:,.0f}', share_quantity) || '股' AS volume,
        CASE WHEN length(asset_name) <= 8 THEN asset_name ELSE substr(asset_name, 1, 7) || '…' END AS short_name,
        strftime(report_date, '%Y-%m-%d') AS day
    FROM (SELECT *, CAST(market_value AS DECIMAL(30, 6)) AS v FROM holdings)""", "holdings"))
def holding_labels(d: Domain) -> DataFrame:
    return d.holdings().select(
        "product_id",
        "asset_code",
        text.label(F.col("asset_type"), C.ASSET_CLASS_LABELS).alias("asset_label"),
        text.label(F.col("market"), C.MARKET_LABELS).alias("market_label"),
        text.money_text(F.col("market_value")).alias("money"),
        text.volume_text(F.col("share_quantity"), F.lit("share")).alias("volume"),
        text.truncate(F.col("asset_name"), 8).alias("short_name"),
        text.date_text(F.col("report_date")).alias("day"),
    )


DASHBOARD = """
    SELECT 'product_total' AS metric, CAST(count(*) AS VARCHAR) AS value FROM snapshots
    UNION ALL SELECT 'institution_total', CAST(count(DISTINCT institution_code) AS VARCHAR) FROM snapshots
    UNION ALL SELECT 'nav_total', CAST(count(*) AS VARCHAR) FROM snapshot_nav
    UNION ALL SELECT 'holding_total', CAST(count(*) AS VARCHAR) FROM holdings
    UNION ALL SELECT 'products_with_holding', CAST(count(DISTINCT product_id) AS VARCHAR) FROM holdings
    UNION ALL SELECT 'latest_holding_date', CAST(max(report_date) AS VARCHAR) FROM holdings
    UNION ALL SELECT 'report_total', CAST(count(*) AS VARCHAR) FROM snapshot_reports"""


@query(sql(DASHBOARD, "snapshots", "snapshot_nav", "holdings", "snapshot_reports"))
def dashboard_totals(d: Domain) -> DataFrame:
    return reports.dashboard_totals(d.snapshots(), d.snapshot_nav(), d.holdings(), d.snapshot_reports())


@query(sql("""SELECT 'type' AS split, asset_type AS a, CAST(NULL AS VARCHAR) AS b, count(*) AS count
        FROM holdings GROUP BY asset_type
    UNION ALL SELECT 'institution', institution_code, NULL, count(*) FROM holdings JOIN products USING (product_id)
        GROUP BY institution_code
    UNION ALL SELECT 'institution_type', institution_code, product_type, count(*) FROM snapshots
        GROUP BY institution_code, product_type""", "holdings", "products", "snapshots"))
def dashboard_breakdowns(d: Domain) -> DataFrame:
    none = F.lit(None).cast("string")
    by_type = reports.count_by(d.holdings(), "asset_type")
    by_inst = reports.holdings_by_institution(d.products(), d.holdings())
    both = reports.count_by(d.snapshots(), "institution_code", "product_type")
    return (
        by_type.select(F.lit("type").alias("split"), F.col("asset_type").alias("a"), none.alias("b"), "count")
        .unionByName(by_inst.select(F.lit("institution").alias("split"), F.col("institution_code").alias("a"), none.alias("b"), "count"))
        .unionByName(both.select(F.lit("institution_type").alias("split"), F.col("institution_code").alias("a"), F.col("product_type").alias("b"), "count"))
    )


@query(sql("""SELECT DISTINCT institution_code FROM products WHERE product_id IN (SELECT product_id
    FROM holdings WHERE report_date = (SELECT max(report_date) FROM holdings))""", "holdings", "products"))
def latest_holding_institutions(d: Domain) -> DataFrame:
    return reports.latest_holding_institutions(d.products(), d.holdings())


@query(sql("""SELECT job_name, end_time FROM logs WHERE status = 'success'
    ORDER BY end_time DESC NULLS LAST, id DESC LIMIT 1""", "logs"))
def last_successful_job(d: Domain) -> DataFrame:
    return reports.last_success(d.logs())


@query(sql("""SELECT job_name, institution_code, substr(coalesce(error_message, ''), 1, 80) AS error, created_at
    FROM logs WHERE status = 'failed' AND created_at > (SELECT max(ts) FROM events) - INTERVAL 7 DAY
    ORDER BY created_at DESC, id DESC LIMIT 10""", "logs"))
def recent_failures(d: Domain) -> DataFrame:
    now = d.raw("events").agg(F.max("ts")).scalar()
    return reports.recent_failures(d.logs(), now)


@query(sql("""SELECT id, job_name, status, start_time FROM logs WHERE institution_code = 'I3'
    ORDER BY start_time DESC, id DESC LIMIT 5""", "logs"))
def recent_logs_of_institution(d: Domain) -> DataFrame:
    return reports.recent_logs(d.logs(), "I3", 5).select("id", "job_name", "status", "start_time")


@query(sql("""SELECT region, count, latest_date, symbol_count FROM (
        SELECT market_region AS region, count(*) AS count FROM market_quotes GROUP BY 1),
    (SELECT max(quote_date) AS latest_date, count(DISTINCT symbol_code) AS symbol_count FROM market_quotes)""",
           "market_quotes"))
def market_summary(d: Domain) -> DataFrame:
    q = d.market_quotes()
    totals = reports.market_totals(q)
    return reports.count_by(q, "market_region").select(
        F.col("market_region").alias("region"),
        "count",
        totals.select("latest_date").scalar().alias("latest_date"),
        totals.select("symbol_count").scalar().alias("symbol_count"),
    )


COLLECTION = """
    SELECT 'product_total' AS metric, CAST(count(DISTINCT institution_code || ':' || product_code) AS VARCHAR) AS value
        FROM snapshots
    UNION ALL SELECT 'latest_collect_date', CAST(max(collect_date) AS VARCHAR) FROM snapshots
    UNION ALL SELECT 'product_with_nav', CAST(count(DISTINCT institution_code || ':' || product_code) AS VARCHAR)
        FROM snapshots JOIN snapshot_nav USING (product_id)
    UNION ALL SELECT 'product_with_holding', CAST(count(DISTINCT institution_code || ':' || product_code) AS VARCHAR)
        FROM snapshots JOIN snapshot_reports USING (product_id)
    UNION ALL SELECT 'nav_total', CAST(count(*) AS VARCHAR) FROM snapshot_nav
    UNION ALL SELECT 'holding_total', CAST(count(*) AS VARCHAR) FROM holdings
    UNION ALL SELECT 'market_quote_total', CAST(count(*) AS VARCHAR) FROM market_quotes
    UNION ALL SELECT 'market_quote_latest_date', CAST(max(quote_date) AS VARCHAR) FROM market_quotes
    UNION ALL SELECT 'market_quote_symbol_count', CAST(count(DISTINCT symbol_code) AS VARCHAR) FROM market_quotes
        WHERE quote_date >= (SELECT CAST(max(ts) AS DATE) FROM events) - 2"""
COLLECTION_CTES = ("snapshots", "snapshot_nav", "snapshot_reports", "holdings", "market_quotes")


def _collection(d: Domain) -> DataFrame:
    return reports.collection_totals(
        d.snapshots(), d.snapshot_nav(), d.holdings(), d.snapshot_reports(), d.market_quotes(), d.event_day()
    )


@query(sql(COLLECTION, *COLLECTION_CTES))
def collection_totals(d: Domain) -> DataFrame:
    return _collection(d)


@query(sql(f"""
    SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, advice FROM (
        SELECT 1 AS o, CAST(a - b AS VARCHAR) || ' 个产品仍无净值记录，建议排查对应机构采集器或补充数据源。' AS advice
            FROM v WHERE a > b
        UNION ALL SELECT 2, CAST(a - c AS VARCHAR) || ' 个产品仍无持仓数据，可扩展债券持仓、资产配置及银行理财持仓采集。'
            FROM v WHERE a > c
        UNION ALL SELECT 3, '最新行情日缺少 ' || CAST({len(C.MARKET_SYMBOLS)} - s AS VARCHAR) ||
            ' 个品种，建议检查 market_quote 采集或补充数据源。' FROM v WHERE s < {len(C.MARKET_SYMBOLS)})""",
    *COLLECTION_CTES,
    extra=(("m", COLLECTION), ("v", """
        SELECT max(CASE WHEN metric = 'product_total' THEN CAST(value AS BIGINT) END) AS a,
            max(CASE WHEN metric = 'product_with_nav' THEN CAST(value AS BIGINT) END) AS b,
            max(CASE WHEN metric = 'product_with_holding' THEN CAST(value AS BIGINT) END) AS c,
            max(CASE WHEN metric = 'market_quote_symbol_count' THEN CAST(value AS BIGINT) END) AS s
        FROM (SELECT metric, CASE WHEN metric LIKE '%date' THEN NULL ELSE value END AS value FROM m)"""))))
def collection_advice(d: Domain) -> DataFrame:
    return reports.advice(_collection(d), len(C.MARKET_SYMBOLS))


@query(sql(f"""
    SELECT l.product_id, l.institution_code, l.product_code, l.collect_date
    FROM (SELECT * FROM (SELECT *, max(collect_date) OVER (PARTITION BY institution_code, product_code) AS md
          FROM snapshots) WHERE collect_date = md) l
    LEFT JOIN (SELECT product_id, max(report_date) AS rd FROM snapshot_reports GROUP BY 1) r USING (product_id)
    WHERE r.rd IS NULL OR r.rd < (SELECT max(report_date) FROM snapshot_reports)""", "snapshots", "snapshot_reports"))
def fetch_work_list(d: Domain) -> DataFrame:
    return latest.fetch_work_list(d.snapshots(), d.snapshot_reports()).select(
        "product_id", "institution_code", "product_code", "collect_date"
    )


@query(sql(f"""
    SELECT symbol_code FROM (VALUES {SYMBOL_VALUES}) t(symbol_code) WHERE symbol_code NOT IN (
        SELECT symbol_code FROM market_quotes WHERE quote_date >= (SELECT CAST(max(ts) AS DATE) FROM events) - 2)""",
           "market_quotes"))
def expected_symbols_missing(d: Domain) -> DataFrame:
    expected = quote_feed.symbol_table(d.spark).select("symbol_code")
    return reports.missing_symbols(expected, d.market_quotes(), F.date_sub(d.event_day(), 2))


@query(sql(f"""
    SELECT coalesce(source, 'failed') AS source, count(*) AS total, count(source) AS success,
        count(*) - count(source) AS failed
    FROM (VALUES {SYMBOL_VALUES}) t(symbol_code)
    LEFT JOIN (SELECT symbol_code, min(symbol_name) AS source FROM market_quotes GROUP BY 1) q USING (symbol_code)
    GROUP BY 1""", "market_quotes"))
def collection_status_by_source(d: Domain) -> DataFrame:
    seen = d.market_quotes().withColumn("data_source", F.col("symbol_name"))
    return reports.source_status(quote_feed.symbol_status(quote_feed.symbol_table(d.spark), seen))


@query(sql("""SELECT asset_code, market, max(asset_name) AS asset_name FROM holdings WHERE asset_type = 'stock'
    GROUP BY 1, 2""", "holdings"))
def holding_symbols(d: Domain) -> DataFrame:
    return reports.holding_symbols(d.holdings(), d.report_date())


@query(sql("""SELECT CAST(CAST(round(100 * CAST((SELECT count(DISTINCT product_id) FROM holdings) AS DECIMAL(18, 0))
        / count(*), 1) AS DECIMAL(9, 1)) AS VARCHAR) || '%' AS share FROM snapshots""", "holdings", "snapshots"))
def holding_product_share(d: Domain) -> DataFrame:
    return reports.holding_share(d.snapshots(), d.holdings())


NAMES = """SELECT asset_code, asset_name FROM (SELECT *, row_number() OVER (PARTITION BY asset_code ORDER BY
    coalesce(list_position(['SH', 'SZ', 'BJ', 'HK'], market), 5), market) AS rn FROM securities) WHERE rn = 1"""


@query(sql(f"""SELECT h.product_id AS cluster_id, h.asset_code, coalesce(n.asset_name, h.asset_code, '—') AS asset_name
    FROM holdings h LEFT JOIN ({NAMES}) n USING (asset_code)""", "holdings", "securities"))
def named_cluster_holdings(d: Domain) -> DataFrame:
    top = d.holdings().select(F.col("product_id").alias("cluster_id"), "asset_code")
    return browse.named_holdings(top, d.securities())


@query(sql("""
    SELECT s.institution_code, s.product_code, s.report_id, s.report_period, count(*) AS holdings,
        count(i.asset_name) AS known_securities, round(sum(l.l_extendedprice), 2) AS market_value
    FROM (SELECT * FROM (SELECT p.institution_code, p.product_code, r.report_id, r.report_period, row_number() OVER (
              PARTITION BY p.institution_code, p.product_code ORDER BY r.report_date DESC, r.report_id DESC) AS rn
          FROM (SELECT * FROM (SELECT r.*, p.institution_code AS ic, p.product_code AS pc, p.collect_date,
                    row_number() OVER (PARTITION BY p.institution_code, p.product_code, r.report_date
                        ORDER BY p.collect_date DESC, r.report_id DESC) AS rr
                FROM snapshot_reports r JOIN snapshots p USING (product_id)) WHERE rr = 1) r
          JOIN snapshots p ON p.product_id = r.product_id) WHERE rn = 1) s
    JOIN lineitem l ON l.l_orderkey = s.report_id JOIN parts t ON t.p_partkey = l.l_partkey
    LEFT JOIN securities i ON i.asset_code = t.asset_code AND i.market = t.market
    GROUP BY 1, 2, 3, 4""", "snapshots", "snapshot_reports", "parts", "securities"))
def product_detail(d: Domain) -> DataFrame:
    lines = d.raw("lineitem")
    held = lines.join(d.parts(), lines["l_partkey"] == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("report_id"),
        F.col("l_orderkey").alias("product_id"),
        "asset_code",
        F.col("p_name").alias("asset_name"),
        "market",
        F.col("l_extendedprice").alias("market_value"),
    )
    history = d.snapshot_reports()
    rows = browse.product_detail(
        d.snapshots(), history.drop("holding_count", "top10_weight"), history, held, d.securities()
    )
    return rounded(
        rows.groupBy("institution_code", "product_code", "report_id", "report_period").agg(
            F.count(F.lit(1)).alias("holdings"),
            F.count("security_name").alias("known_securities"),
            F.sum("market_value").alias("market_value"),
        ),
        "market_value",
        digits=2,
    )


@query(sql("""SELECT o_custkey AS product_id, make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31) AS report_date,
        o_orderstatus AS dimension, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS tags
    FROM orders GROUP BY 1, 2, 3"""))
def style_tags_by_dimension(d: Domain) -> DataFrame:
    tags = d.raw("orders").select(
        F.col("o_custkey").alias("product_id"),
        F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31)).alias("report_date"),
        F.col("o_orderstatus").alias("dimension"),
        F.col("o_orderpriority").alias("tag"),
    )
    return browse.tags_by_dimension(tags)


@query(sql("""SELECT product_id, nav_date, unit_nav FROM fund_nav
    WHERE product_id = (SELECT product_id FROM fund_nav GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    ORDER BY nav_date DESC LIMIT 50""", "fund_nav"))
def nav_list_of_product(d: Domain) -> DataFrame:
    nav = d.fund_nav()
    longest = nav.groupBy("product_id").count().orderBy(F.col("count").desc(), "product_id").limit(1)
    mine = F.col("product_id") == longest.select("product_id").scalar()
    rows = browse.sorted_list(nav, mine, [F.col("nav_date").desc()], 50)
    return rows.select("product_id", "nav_date", "unit_nav")


@query(sql("""SELECT asset_code, market, asset_name, industry_name FROM securities
    WHERE asset_code = (SELECT max(asset_code) FROM securities)
    ORDER BY market LIMIT 1""", "securities"))
def security_lookup(d: Domain) -> DataFrame:
    s = d.securities()
    code = s.agg(F.max("asset_code")).scalar()
    return browse.by_key(s, "asset_code", code).select("asset_code", "market", "asset_name", "industry_name")


@query(sql("""SELECT product_type, count(*) AS products, max(unit_nav) AS top_nav FROM snapshots
    JOIN snapshot_nav USING (product_id) WHERE collect_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
    AND risk_level_standard IN ('L1', 'L3') GROUP BY 1""", "snapshots", "snapshot_nav"))
def parameterised_sql(d: Domain) -> DataFrame:
    return run_sql(
        d.spark,
        """SELECT product_type, count(*) AS products, max(unit_nav) AS top_nav
           FROM snapshots JOIN snapshot_nav USING (product_id)
           WHERE collect_date BETWEEN :first AND :last AND array_contains(:levels, risk_level_standard)
           GROUP BY product_type""",
        {
            "first": date(1996, 1, 1),
            "last": date(1999, 12, 31),
            "levels": F.array(F.lit("L1"), F.lit("L3")),
        },
        snapshots=d.snapshots(),
        snapshot_nav=d.snapshot_nav(),
    )


@query(sql("""SELECT '{"product_id":' || CAST(product_id AS VARCHAR) || ',"collect_date":"' ||
        CAST(collect_date AS VARCHAR) || '","status":"' || status || '"}' AS json FROM products""", "products"))
def products_as_json(d: Domain) -> DataFrame:
    return as_json(d.products().select("product_id", "collect_date", "status"))


@query(sql("""SELECT product_id, nav_date,
        CASE WHEN CAST(day AS INTEGER) < 5 THEN 5 WHEN CAST(day AS INTEGER) > 20 THEN 20
            ELSE CAST(day AS INTEGER) END AS clamped,
        nav_date AS parsed, CAST(CAST(round(unit_nav * CAST(0.01 AS DECIMAL(4, 2)), 2) AS DECIMAL(30, 2)) AS VARCHAR) || '%' AS percent
    FROM (SELECT product_id, nav_date, day(nav_date) AS day, CAST(unit_nav AS DECIMAL(18, 2)) AS unit_nav
          FROM snapshot_nav)""", "snapshot_nav"))
def lenient_parsing(d: Domain) -> DataFrame:
    text_day = F.date_format("nav_date", "yyyy/MM/dd")
    return d.snapshot_nav().select(
        "product_id",
        "nav_date",
        parsing.clamp(F.dayofmonth("nav_date"), 5, 20).alias("clamped"),
        parsing.to_date(F.concat(F.lit("  "), text_day, F.lit(" 00:00:00"))).alias("parsed"),
        text.percent_text(F.col("unit_nav") / 100).alias("percent"),
    )
