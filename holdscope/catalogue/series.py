"""Queries: latest and historical values, windows, composites, returns and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain, sql
from holdscope.catalogue.registry import query, rounded
from holdscope.functions import constants as C
from holdscope.functions import text
from holdscope.operators import latest, overlay, returns, timeseries
from holdscope.sources import quotes as quote_feed

END = "(SELECT CAST(max(ts) AS DATE) FROM events)"


@query(sql("""
    SELECT institution_code, product_code, nav_date, unit_nav FROM (
        SELECT *, row_number() OVER (PARTITION BY institution_code, product_code ORDER BY nav_date DESC) AS n FROM (
            SELECT s.institution_code, s.product_code, v.*, row_number() OVER (
                PARTITION BY s.institution_code, s.product_code, v.nav_date ORDER BY v.id DESC) AS rn
            FROM fund_nav v JOIN fund_snapshots s USING (product_id)) WHERE rn = 1) WHERE n <= 10""",
    "fund_nav", "fund_snapshots"))
def nav_history(d: Domain) -> DataFrame:
    rows = latest.nav_history(d.fund_nav(), d.fund_snapshots(), 10)
    return rows.select("institution_code", "product_code", "nav_date", "unit_nav")


@query(sql("""SELECT institution_code, product_code, count(DISTINCT nav_date) AS nav_dates
    FROM fund_nav JOIN fund_snapshots USING (product_id) GROUP BY 1, 2""", "fund_nav", "fund_snapshots"))
def nav_date_count(d: Domain) -> DataFrame:
    return latest.nav_date_count(d.fund_nav(), d.fund_snapshots())


REPORT_HISTORY = """
    SELECT * FROM (SELECT r.*, p.institution_code, p.product_code, p.collect_date, row_number() OVER (
        PARTITION BY p.institution_code, p.product_code, r.report_date
        ORDER BY p.collect_date DESC, r.report_id DESC) AS rn
    FROM snapshot_reports r JOIN snapshots p USING (product_id)) WHERE rn = 1"""


@query(sql(f"""SELECT institution_code, product_code, report_id, report_date, report_period, holding_count,
    round(top10_weight, 6) AS top10_weight FROM ({REPORT_HISTORY})""", "snapshot_reports", "snapshots"))
def report_history(d: Domain) -> DataFrame:
    r = d.snapshot_reports()
    rows = latest.report_history(r.drop("holding_count", "top10_weight"), d.snapshots(), r)
    return rounded(rows, "top10_weight").select(
        "institution_code", "product_code", "report_id", "report_date", "report_period", "holding_count", "top10_weight"
    )


@query(sql("""SELECT institution_code, product_code, report_id, report_date FROM (
    SELECT r.*, p.institution_code, p.product_code, row_number() OVER (PARTITION BY p.institution_code, p.product_code
        ORDER BY r.report_date DESC, p.collect_date DESC, r.report_id DESC) AS rn
    FROM snapshot_reports r JOIN snapshots p USING (product_id)) WHERE rn = 1""", "snapshot_reports", "snapshots"))
def latest_report_per_product(d: Domain) -> DataFrame:
    return latest.latest_report(d.snapshot_reports(), d.snapshots()).select(
        "institution_code", "product_code", "report_id", "report_date"
    )


@query(sql("""SELECT symbol_code, quote_date, market_region, asset_class, close_price
    FROM market_quotes q WHERE quote_date = (SELECT max(quote_date) FROM market_quotes m
        WHERE m.symbol_code = q.symbol_code) AND asset_class IN ('index', 'commodity')""", "market_quotes"))
def latest_quote_per_symbol(d: Domain) -> DataFrame:
    rows = latest.latest_quotes(d.market_quotes(), asset_classes=C.DEFAULT_MARKET_CLASSES)
    return rows.select("symbol_code", "quote_date", "market_region", "asset_class", "close_price")


@query(sql("""SELECT symbol_code, quote_date, close_price FROM quotes q
    WHERE quote_date = (SELECT max(quote_date) FROM quotes m WHERE m.symbol_code = q.symbol_code)""", "quotes"))
def latest_stock_quotes(d: Domain) -> DataFrame:
    rows = latest.latest_by_max_date(d.quotes(), ["symbol_code"], "quote_date")
    return rows.select("symbol_code", "quote_date", "close_price")


WANTED = ", ".join(f"('{s[0]}')" for s in C.MARKET_SYMBOLS)


@query(sql(f"""SELECT w.symbol_code, q.quote_date, q.close_price
    FROM (VALUES {WANTED}) w(symbol_code) LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY symbol_code ORDER BY quote_date DESC) AS rn FROM market_quotes
        WHERE quote_date <= {END} - 3) WHERE rn <= 12) q ON q.symbol_code = w.symbol_code""", "market_quotes"))
def last_rows_per_symbol(d: Domain) -> DataFrame:
    symbols = quote_feed.symbol_table(d.spark)
    return timeseries.quote_history(d.market_quotes(), symbols, 12, F.date_sub(d.event_day(), 3))


@query(sql("""SELECT symbol_code, count(*) AS records, min(quote_date) AS first_date, max(quote_date) AS last_date
    FROM quotes WHERE quote_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY 1""", "quotes"))
def window_coverage_by_symbol(d: Domain) -> DataFrame:
    return timeseries.window_coverage(
        d.quotes(), F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")
    )


# Attribution window of the stock price queries.
START_DAY, END_DAY = "1998-01-15", "1999-06-30"
RETURNS = f"""
    SELECT symbol_code, e.close_price / s.close_price - 1.0 AS stock_return
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_code ORDER BY quote_date DESC) AS rn
          FROM quotes WHERE quote_date BETWEEN DATE '{START_DAY}' - 90 AND DATE '{START_DAY}') WHERE rn = 1) s
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_code ORDER BY quote_date DESC) AS rn
          FROM quotes WHERE quote_date BETWEEN DATE '{END_DAY}' - 90 AND DATE '{END_DAY}') WHERE rn = 1) e
        USING (symbol_code)
    WHERE s.close_price > 0 AND e.close_price <> 0"""


def stock_returns(d: Domain) -> DataFrame:
    start, end = (F.lit(x).cast("date") for x in (START_DAY, END_DAY))
    return timeseries.asof_returns(d.quotes(), start, end, 90)


@query(sql(f"SELECT symbol_code, round(stock_return, 6) AS stock_return FROM ({RETURNS})", "quotes"))
def asof_window_return(d: Domain) -> DataFrame:
    return rounded(stock_returns(d), "stock_return")


DAYS = 25
FUND_CTES = ("fund_members", "fund_snapshots", "fund_nav", "fund_holdings")
MEMBER_NAV = ("member_nav", f"""
    SELECT cluster_id, institution_code, product_code, nav_date, nav FROM (
        SELECT l.cluster_id, s.institution_code, s.product_code, v.nav_date, v.unit_nav AS nav, row_number() OVER (
            PARTITION BY l.cluster_id, s.institution_code, s.product_code, v.nav_date ORDER BY v.product_id) AS rn
        FROM (SELECT DISTINCT m.cluster_id, s.institution_code, s.product_code
              FROM fund_members m JOIN fund_snapshots s USING (product_id)) l
        JOIN fund_snapshots s USING (institution_code, product_code)
        JOIN fund_nav v ON v.product_id = s.product_id
        WHERE v.nav_date BETWEEN {END} - {DAYS} AND {END}) WHERE rn = 1""")
MEMBER_VALUES = ("member_values", f"""
    SELECT m.cluster_id, m.product_id, s.institution_code, s.product_code, z.latest_nav_date, z.latest_unit_nav,
        z.earliest_nav_date, z.earliest_unit_nav,
        CASE WHEN z.latest_nav_date <> z.earliest_nav_date THEN z.latest_nav_date - z.earliest_nav_date END AS span_days,
        coalesce(z.n, 0) AS nav_record_count,
        CASE WHEN z.latest_nav_date <> z.earliest_nav_date AND z.earliest_unit_nav <> 0
            THEN (z.latest_unit_nav - z.earliest_unit_nav) / z.earliest_unit_nav END AS period_change_pct,
        {END} - {DAYS} AS window_start, {END} AS window_end,
        coalesce(h.mv, 0) AS holding_market_value, coalesce(h.w, 0) AS holding_weight
    FROM fund_members m JOIN fund_snapshots s USING (product_id)
    LEFT JOIN (SELECT cluster_id, institution_code, product_code, max(nav_date) AS latest_nav_date,
                   min(nav_date) AS earliest_nav_date, arg_max(nav, nav_date) AS latest_unit_nav,
                   arg_min(nav, nav_date) AS earliest_unit_nav, count(*) AS n
               FROM member_nav GROUP BY 1, 2, 3) z
        ON z.cluster_id = m.cluster_id AND z.institution_code = s.institution_code AND z.product_code = s.product_code
    LEFT JOIN (SELECT product_id, sum(market_value) AS mv, sum(weight) AS w FROM fund_holdings GROUP BY 1) h
        ON h.product_id = m.product_id""")


def _member_values(d: Domain) -> DataFrame:
    return timeseries.member_values(
        d.fund_members(), d.fund_snapshots(), d.fund_nav(), d.fund_holdings(), d.event_day(), DAYS
    )


@query(sql("""SELECT cluster_id, product_id, institution_code, product_code, latest_nav_date,
        round(latest_unit_nav, 6) AS latest_unit_nav, earliest_nav_date, round(earliest_unit_nav, 6) AS earliest_unit_nav,
        span_days, nav_record_count, round(period_change_pct, 6) AS period_change_pct, window_start, window_end,
        round(holding_market_value, 2) AS holding_market_value, round(holding_weight, 6) AS holding_weight
    FROM member_values""", *FUND_CTES, extra=(MEMBER_NAV, MEMBER_VALUES)))
def member_value_snapshot(d: Domain) -> DataFrame:
    rows = rounded(
        _member_values(d), "latest_unit_nav", "earliest_unit_nav", "period_change_pct", "holding_weight"
    )
    return rounded(rows, "holding_market_value", digits=2)


@query(sql("""SELECT cluster_id, count(c) AS n, round(avg(c), 6) AS mean_change,
        round(CASE WHEN count(c) > 1 THEN stddev_samp(c) WHEN count(c) = 1 THEN 0 END, 6) AS std_change,
        round(min(c), 6) AS min_change, round(max(c), 6) AS max_change, round(max(c) - min(c), 6) AS range_pct,
        round(avg(CASE WHEN c > 0 THEN 1.0 WHEN c IS NOT NULL THEN 0.0 END), 6) AS positive_share,
        round(median(c), 6) AS median_change,
        round(CASE WHEN avg(c) = 0 THEN 0 ELSE coalesce(stddev_samp(c), 0) / abs(avg(c)) END, 6) AS coefficient_of_variation,
        round(avg(v), 6) AS mean_nav, round(min(v), 6) AS min_nav, round(max(v), 6) AS max_nav
    FROM (SELECT cluster_id, period_change_pct AS c, latest_unit_nav AS v FROM member_values) GROUP BY 1""",
    *FUND_CTES, extra=(MEMBER_NAV, MEMBER_VALUES)))
def value_dispersion(d: Domain) -> DataFrame:
    rows = timeseries.value_dispersion(_member_values(d))
    return rounded(rows, *[c for c in rows.columns if c not in ("cluster_id", "n")])


@query(sql("""SELECT cluster_id, product_id, round(c, 6) AS period_change_pct, position, side FROM (
        SELECT cluster_id, product_id, period_change_pct AS c, 'top' AS side,
            row_number() OVER (PARTITION BY cluster_id ORDER BY period_change_pct DESC, product_id) AS position
        FROM member_values WHERE period_change_pct IS NOT NULL
        UNION ALL SELECT cluster_id, product_id, period_change_pct, 'bottom',
            row_number() OVER (PARTITION BY cluster_id ORDER BY period_change_pct, product_id DESC)
        FROM member_values WHERE period_change_pct IS NOT NULL) WHERE position <= 5""",
    *FUND_CTES, extra=(MEMBER_NAV, MEMBER_VALUES)))
def extreme_movers(d: Domain) -> DataFrame:
    return rounded(timeseries.extreme_movers(_member_values(d)), "period_change_pct")


COMPOSITE = ("composite", """
    SELECT d.cluster_id, d.nav_date, d.covered, a.nav_date AS anchor_date, a.level AS anchor_value,
        d.level / a.level * 100.0 AS close
    FROM (SELECT cluster_id, nav_date, avg(nav) AS level, count(*) AS covered FROM member_nav GROUP BY 1, 2) d
    JOIN (SELECT * FROM (
            SELECT g.*, row_number() OVER (PARTITION BY g.cluster_id ORDER BY
                CASE WHEN g.covered >= greatest(1, floor(n.n * 0.8)) THEN 0 ELSE 1 END, g.nav_date) AS rn
            FROM (SELECT cluster_id, nav_date, avg(nav) AS level, count(*) AS covered FROM member_nav GROUP BY 1, 2) g
            JOIN (SELECT cluster_id, count(*) AS n FROM fund_members GROUP BY 1) n USING (cluster_id)) WHERE rn = 1) a
        USING (cluster_id)""")


def _composite(d: Domain) -> DataFrame:
    return timeseries.composite_series(d.fund_members(), d.fund_snapshots(), d.fund_nav(), d.event_day(), DAYS)


@query(sql("""SELECT cluster_id, nav_date, covered, anchor_date, round(anchor_value, 6) AS anchor_value,
    round(close, 6) AS close FROM composite""", *FUND_CTES, extra=(MEMBER_NAV, COMPOSITE)))
def composite_index_rebased(d: Domain) -> DataFrame:
    return rounded(_composite(d), "close", "anchor_value")


@query(sql("""SELECT cluster_id, any_value(anchor_date) AS start_date, max(nav_date) AS end_date, 100.0 AS start_value,
        round(arg_max(close, nav_date), 6) AS end_value, round(arg_max(close, nav_date) / 100.0 - 1.0, 6) AS change_pct
    FROM composite GROUP BY 1 HAVING count(*) >= 2""", *FUND_CTES, extra=(MEMBER_NAV, COMPOSITE)))
def composite_period_changes(d: Domain) -> DataFrame:
    return rounded(timeseries.composite_changes(_composite(d)), "start_value", "end_value", "change_pct")


@query(sql("""SELECT s.symbol_code, d.quote_date, round(q.close_price / b.base * 100.0, 2) AS rebased
    FROM (SELECT DISTINCT symbol_code FROM market_quotes) s, (SELECT DISTINCT quote_date FROM market_quotes) d
    JOIN (SELECT symbol_code, arg_min(close_price, quote_date) AS base FROM market_quotes GROUP BY 1) b
        ON b.symbol_code = s.symbol_code
    LEFT JOIN market_quotes q ON q.symbol_code = s.symbol_code AND q.quote_date = d.quote_date""", "market_quotes"))
def rebased_overlay(d: Domain) -> DataFrame:
    """A chart of all index symbols: each rebased to its first close."""
    return timeseries.rebased_overlay(d.market_quotes())


WEB_MARKET = """CASE WHEN regexp_matches(code, '^[0-9]{5}$') THEN 'HK' WHEN regexp_matches(code, '^[A-Za-z]{1,5}$') THEN 'US'
    WHEN regexp_matches(code, '^(60|68|51|52|53)') THEN 'SH' WHEN regexp_matches(code, '^(00|30|39|12|08)') THEN 'SZ'
    WHEN regexp_matches(code, '^(8|4|43)') THEN 'BJ' ELSE 'UNKNOWN' END"""
BASE_MARKET = """CASE WHEN regexp_matches(code, '^(60|68|51|52|53)') THEN 'SH'
    WHEN regexp_matches(code, '^(00|30|39|12|08)') THEN 'SZ' WHEN regexp_matches(code, '^(8|4|43)') THEN 'BJ'
    WHEN length(code) = 5 THEN 'HK' ELSE 'UNKNOWN' END"""
TOP = ("top_holdings", """SELECT product_id AS cluster_id, asset_code, weight FROM holdings""")
BREAKDOWN = ("breakdown", f"""SELECT cluster_id, market, sum(weight) AS weight FROM (
    SELECT cluster_id, {WEB_MARKET.replace("code", "asset_code")} AS market, weight FROM top_holdings WHERE weight > 0)
    GROUP BY 1, 2""")


def _breakdown(d: Domain) -> DataFrame:
    return overlay.market_breakdown(
        d.holdings().select(F.col("product_id").alias("cluster_id"), "asset_code", "weight")
    )


@query(sql("""SELECT cluster_id, market, round(weight, 6) AS weight, CASE market WHEN 'SH' THEN '上海A股'
    WHEN 'SZ' THEN '深圳A股' WHEN 'BJ' THEN '北交所' WHEN 'HK' THEN '港股' WHEN 'US' THEN '美股' ELSE '未识别' END AS label
    FROM breakdown""", "holdings", extra=(TOP, BREAKDOWN)))
def market_breakdown(d: Domain) -> DataFrame:
    return rounded(_breakdown(d), "weight")


@query(sql(f"""SELECT asset_code, {BASE_MARKET.replace("code", "asset_code")} AS base_market,
        {WEB_MARKET.replace("code", "asset_code")} AS web_market, market || asset_code AS symbol_code,
        CASE WHEN length(market || asset_code) >= 6 THEN regexp_replace(market || asset_code, '^(SH|SZ|BJ)', '')
            ELSE market || asset_code END AS bare_code,
        CASE market WHEN 'SH' THEN '1' WHEN 'SZ' THEN '0' WHEN 'HK' THEN '128' WHEN 'BJ' THEN '1' END AS prefix,
        CASE WHEN market = 'HK' THEN 'hk' ELSE 'domestic' END AS region,
        CASE WHEN market = 'HK' THEN 'HKD' ELSE 'CNY' END AS currency,
        CASE WHEN market IN ('SH', 'SZ', 'BJ') THEN 'domestic' ELSE lower(market) END AS bundle
    FROM securities""", "securities"))
def security_markets(d: Domain) -> DataFrame:
    code, market = F.col("asset_code"), F.col("market")
    return d.securities().select(
        "asset_code",
        text.infer_market(code).alias("base_market"),
        text.infer_market_web(code).alias("web_market"),
        text.symbol_code(code, market).alias("symbol_code"),
        text.strip_exchange(text.symbol_code(code, market)).alias("bare_code"),
        text.kline_prefix(market).alias("prefix"),
        text.market_region(market).alias("region"),
        text.market_currency(market).alias("currency"),
        text.bundle_key(market).alias("bundle"),
    )


@query(sql(f"""
    SELECT DISTINCT p.cluster_id, p.symbol_code, s.symbol_name, s.market_region,
        round(coalesce(b.weight, 0), 6) AS weight, h.quote_date, h.close_price
    FROM (SELECT DISTINCT cluster_id, 'SH000300' AS symbol_code FROM top_holdings
          UNION SELECT cluster_id, unnest(CASE WHEN market IN ('SH', 'SZ', 'BJ') THEN ['SH000300', 'SH000001', 'SZ399006']
                  WHEN market = 'HK' THEN ['HSI'] WHEN market = 'US' THEN ['NDX', 'SPX', 'DJIA'] END)
              FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, market) AS rn
                    FROM breakdown WHERE market <> 'UNKNOWN') WHERE rn = 1
          UNION SELECT cluster_id, unnest(['SH000300', 'SH000001', 'SZ399006']) FROM (
              SELECT cluster_id FROM breakdown GROUP BY 1 HAVING bool_or(market IN ('HK', 'US'))
                  AND bool_or(market IN ('SH', 'SZ', 'BJ')))) p
    JOIN (SELECT symbol_code, symbol_name, market_region FROM market_quotes q WHERE asset_class IN ('index', 'commodity')
          AND quote_date = (SELECT max(quote_date) FROM market_quotes m WHERE m.symbol_code = q.symbol_code)) s
        USING (symbol_code)
    LEFT JOIN breakdown b ON b.cluster_id = p.cluster_id AND b.market =
        {WEB_MARKET.replace("code", "substr(p.symbol_code, 1, 6)")}
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_code ORDER BY quote_date DESC) AS rn
          FROM market_quotes WHERE quote_date <= {END} - 1) WHERE rn <= 20) h ON h.symbol_code = p.symbol_code""",
    "holdings", "market_quotes", extra=(TOP, BREAKDOWN)))
def market_overlay(d: Domain) -> DataFrame:
    breakdown = _breakdown(d)
    clusters = d.holdings().select(F.col("product_id").alias("cluster_id")).distinct()
    rows = overlay.market_overlay(breakdown, clusters, d.market_quotes(), 20, F.date_sub(d.event_day(), 1))
    return rounded(rows, "weight").select(
        "cluster_id", "symbol_code", "symbol_name", "market_region", "weight", "quote_date", "close_price"
    )


# Industry returns: all trading days, each security's brand as its industry.
STOCK_ROWS = ("stock_rows", """
    SELECT q.symbol_code, q.quote_date, q.close_price, i.industry FROM quotes q
    JOIN (SELECT * FROM (SELECT asset_code AS code, industry_name AS industry, row_number() OVER (
              PARTITION BY asset_code ORDER BY market DESC) AS rn
          FROM securities WHERE industry_name IS NOT NULL) WHERE rn = 1) i
        ON i.code = CASE WHEN length(q.symbol_code) >= 6 THEN regexp_replace(q.symbol_code, '^(SH|SZ|BJ)', '')
            ELSE q.symbol_code END""")
# The reference form: a full date x symbol grid with forward-filled closes.
INDUSTRY_RETURNS = ("industry_returns", """
    SELECT industry, quote_date, avg(r) AS industry_return, count(*) OVER (PARTITION BY industry) AS days FROM (
        SELECT industry, quote_date, close / lag(close) OVER (PARTITION BY symbol_code ORDER BY quote_date) - 1.0 AS r
        FROM (SELECT s.symbol_code, s.industry, d.quote_date, last_value(q.close_price IGNORE NULLS) OVER (
                  PARTITION BY s.symbol_code ORDER BY d.quote_date) AS close
              FROM (SELECT DISTINCT symbol_code, industry FROM stock_rows) s
              CROSS JOIN (SELECT DISTINCT quote_date FROM stock_rows) d
              LEFT JOIN stock_rows q ON q.symbol_code = s.symbol_code AND q.quote_date = d.quote_date))
    WHERE r IS NOT NULL AND industry IN (SELECT industry FROM stock_rows GROUP BY 1
        HAVING count(DISTINCT symbol_code) >= 3)
    GROUP BY 1, 2""")
RETURN_CTES = dict(extra=(STOCK_ROWS, INDUSTRY_RETURNS))
KEPT = "SELECT industry, quote_date, industry_return FROM industry_returns WHERE days >= 30"


def _industry_returns(d: Domain) -> DataFrame:
    return returns.industry_returns(returns.with_industry(d.quotes(), d.securities()), min_stocks=3)


@query(sql(f"SELECT industry, quote_date, round(industry_return, 6) AS industry_return FROM ({KEPT})",
           "quotes", "securities", **RETURN_CTES))
def industry_daily_returns(d: Domain) -> DataFrame:
    return rounded(_industry_returns(d), "industry_return")


YEAR = """SELECT * FROM quotes WHERE quote_date BETWEEN (SELECT max(quote_date) FROM quotes) - 365
    AND (SELECT max(quote_date) FROM quotes)"""


@query(sql(f"""SELECT industry, quote_date, round(p / max(CASE WHEN quote_date = first_day THEN p END) OVER (
        PARTITION BY industry) * 100.0, 3) AS level FROM (
        SELECT *, product(1.0 + industry_return) OVER (PARTITION BY industry ORDER BY quote_date) AS p,
            (SELECT min(quote_date) FROM ({KEPT})) AS first_day
        FROM ({KEPT}))""", "quotes", "securities", extra=(
            ("stock_rows", STOCK_ROWS[1].replace("FROM quotes q", f"FROM ({YEAR}) q")), INDUSTRY_RETURNS)))
def cumulative_return_index(d: Domain) -> DataFrame:
    """The report's form: the trailing window first, then returns rebased to its first day."""
    year = timeseries.trailing_window(d.quotes(), 365)
    rows = returns.industry_returns(returns.with_industry(year, d.securities()), min_stocks=3)
    return returns.cumulative_index(rows)


CORR = ("corr", f"""SELECT a.industry AS industry_a, b.industry AS industry_b, count(*) AS n,
        CASE WHEN count(*) >= 20 THEN corr(a.industry_return, b.industry_return) END AS corr
    FROM ({KEPT}) a JOIN ({KEPT}) b USING (quote_date) WHERE a.industry <= b.industry GROUP BY 1, 2""")
CORR_CTES = dict(extra=(STOCK_ROWS, INDUSTRY_RETURNS, CORR))


@query(sql("SELECT industry_a, industry_b, n, round(corr, 6) AS corr FROM corr", "quotes", "securities", **CORR_CTES))
def industry_correlation(d: Domain) -> DataFrame:
    return rounded(returns.correlation(_industry_returns(d)), "corr")


SQUARE = """SELECT industry_a, industry_b, corr FROM corr UNION ALL
    SELECT industry_b, industry_a, corr FROM corr WHERE industry_a < industry_b"""


@query(sql(f"""SELECT (SELECT count(DISTINCT industry_a) FROM corr) AS n_industries,
        (SELECT round(max(corr), 6) FROM corr WHERE industry_a < industry_b) AS max_corr,
        (SELECT round(min(corr), 6) FROM corr WHERE industry_a < industry_b) AS min_corr,
        (SELECT round(avg(m), 6) FROM (SELECT avg(abs(corr)) AS m FROM ({SQUARE}) GROUP BY industry_b)) AS mean_abs_corr""",
           "quotes", "securities", **CORR_CTES))
def correlation_summary(d: Domain) -> DataFrame:
    rows = returns.correlation_summary(returns.correlation(_industry_returns(d)))
    return rounded(rows, "max_corr", "min_corr", "mean_abs_corr")


@query(sql("""SELECT side, industry_a, industry_b, round(corr, 6) AS corr FROM (
        SELECT 'positive' AS side, *, row_number() OVER (ORDER BY corr DESC, industry_a, industry_b) AS rn
            FROM corr WHERE industry_a < industry_b AND corr > 0
        UNION ALL SELECT 'negative', *, row_number() OVER (ORDER BY corr, industry_a, industry_b)
            FROM corr WHERE industry_a < industry_b AND corr < 0
        UNION ALL SELECT 'strongest', *, row_number() OVER (ORDER BY abs(corr) DESC, industry_a, industry_b)
            FROM corr WHERE industry_a < industry_b AND corr IS NOT NULL) WHERE rn <= 10""",
           "quotes", "securities", **CORR_CTES))
def correlation_top_pairs(d: Domain) -> DataFrame:
    return rounded(returns.top_pairs(returns.correlation(_industry_returns(d))), "corr")


REST = f"""SELECT industry_b AS industry, corr FROM ({SQUARE}) WHERE industry_a = (SELECT min(industry_a) FROM corr)
    AND industry_b <> industry_a AND corr IS NOT NULL"""


@query(sql(f"""SELECT side, industry, round(corr, 6) AS corr FROM (
        SELECT 'positive' AS side, *, row_number() OVER (ORDER BY corr DESC, industry) AS rn FROM ({REST}) WHERE corr > 0
        UNION ALL SELECT 'negative', *, row_number() OVER (ORDER BY corr, industry) FROM ({REST}) WHERE corr < 0)
    WHERE rn <= 10 UNION ALL SELECT 'full', industry, round(corr, 6) FROM ({REST})""",
           "quotes", "securities", **CORR_CTES))
def one_industry_against_rest(d: Domain) -> DataFrame:
    corr = returns.correlation(_industry_returns(d))
    first = corr.agg(F.min("industry_a")).scalar()
    return rounded(returns.one_against_rest(corr, first), "corr")


@query(sql(f"""SELECT symbol_code, quote_date, close_price FROM quotes
    WHERE quote_date BETWEEN (SELECT max(quote_date) FROM quotes) - 60 AND (SELECT max(quote_date) FROM quotes)""",
           "quotes"))
def trailing_window(d: Domain) -> DataFrame:
    return timeseries.trailing_window(d.quotes(), 60)
