"""Queries: run details with names, nested results, labels and lenient input."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.browse import NAMES
from holdscope.catalogue.domain import Domain, sql
from holdscope.catalogue.portfolio import CELLS, CENTROIDS, INDUSTRIES, REGIONS, centroids
from holdscope.catalogue.registry import query
from holdscope.catalogue.series import BASE_MARKET
from holdscope.functions import constants as C
from holdscope.functions import parsing, text
from holdscope.operators import browse, holdings, profiling, runs


def _case(column: str, table: dict[str, str]) -> str:
    """SQL of a label lookup: empty is a dash, unknown codes pass through."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE WHEN coalesce({column}, '') = '' THEN '—' ELSE CASE {column} {whens} ELSE {column} END END"


@query(sql(f"""SELECT cluster_id, string_agg(coalesce(n.asset_name, t.feature, '—'), ' | ' ORDER BY rank) AS names,
        string_agg(coalesce(t.feature, '-'), ' | ' ORDER BY rank) AS codes
    FROM (SELECT cluster_id, CASE WHEN rank <> 4 THEN feature END AS feature, rank FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster_id ORDER BY value DESC, feature) AS rank FROM centroids WHERE value > 0) WHERE rank <= 10) t
    LEFT JOIN ({NAMES}) n ON n.asset_code = t.feature GROUP BY 1""",
           "holdings", "securities", extra=(("members", REGIONS), CELLS, CENTROIDS)))
def cluster_holdings_named(d: Domain) -> DataFrame:
    """The stored top holdings of each cluster with names, in rank order; the fourth code is unset."""
    top = profiling.top_features(centroids(d), 10)
    entry = F.struct("rank", F.when(F.col("rank") != 4, F.col("feature")).alias("asset_code"), F.col("value").alias("weight"))
    stored = top.groupBy("cluster_id").agg(F.sort_array(F.collect_list(entry)).alias("top_holdings"))
    stored = stored.select("cluster_id", F.transform("top_holdings", lambda x: x.dropFields("rank")).alias("top_holdings"))
    named = browse.name_arrays(stored, "top_holdings", ["cluster_id"], d.securities())
    return named.select(
        "cluster_id",
        F.array_join(F.transform("top_holdings", lambda x: x["asset_name"]), " | ").alias("names"),
        F.array_join(F.transform("top_holdings", lambda x: F.coalesce(x["asset_code"], F.lit("-"))), " | ").alias("codes"),
    )


@query(sql("""
    SELECT '{"cluster_run_id":"' || r.id || '","report_date":"' || CAST(r.report_date AS VARCHAR) || '","algorithm":"'
        || r.algorithm || '","k":' || CAST(r.k AS VARCHAR) || ',"n_products":' || CAST(r.n_products AS VARCHAR)
        || coalesce(c.body, '') || '}' AS json
    FROM runs r LEFT JOIN (
        SELECT cluster_run_id, ',"cluster_id":' || CAST(cluster_id AS VARCHAR) || ',"size":' || CAST(size AS VARCHAR)
            || ',"part":' || CAST(coalesce(part, 0) AS VARCHAR) || ',"members":[' || coalesce(m.ids, '') || ']' AS body
        FROM run_clusters LEFT JOIN (
            SELECT cluster_run_id, cluster_id, (rn - 1) // 1000 AS part, string_agg('{"product_id":'
                || CAST(product_id AS VARCHAR) || ',"distance":"' || format('{:.6f}', round(distance_to_center, 6)) || '"}',
                ',' ORDER BY rn) AS ids FROM (
                SELECT *, row_number() OVER (PARTITION BY cluster_run_id, cluster_id
                    ORDER BY distance_to_center NULLS LAST, product_id) AS rn FROM run_members)
            GROUP BY 1, 2, 3) m USING (cluster_run_id, cluster_id)) c ON c.cluster_run_id = r.id""",
           "runs", "run_clusters", "run_members"))
def runs_as_json(d: Domain) -> DataFrame:
    return runs.run_payload(d.runs(), d.run_clusters(), d.run_members())


@query(sql(f"""SELECT symbol_code, quote_date, {_case("market_region", C.REGION_LABELS)} AS region FROM market_quotes""",
           "market_quotes"))
def region_labels(d: Domain) -> DataFrame:
    return d.market_quotes().select("symbol_code", "quote_date", text.label(F.col("market_region"), C.REGION_LABELS).alias("region"))


@query(sql(f"""SELECT product_id, {_case("product_type", C.PRODUCT_TYPE_LABELS)} AS product_type FROM products""", "products"))
def product_type_labels(d: Domain) -> DataFrame:
    label = text.label(F.col("product_type"), C.PRODUCT_TYPE_LABELS)
    return d.products().select("product_id", label.alias("product_type"))


@query(sql(f"""SELECT product_id, feature, CAST(row_number() OVER (PARTITION BY product_id ORDER BY raw_weight DESC, feature)
        AS INTEGER) AS position FROM (
        SELECT h.product_id, coalesce(i.industry_name, '未知行业') AS feature, round(sum(h.weight), 9) AS raw_weight
        FROM (SELECT product_id, asset_code, coalesce(market, {BASE_MARKET.replace("code", "asset_code")}) AS market, weight
              FROM holdings) h
        LEFT JOIN industries i ON i.asset_code = h.asset_code AND i.market = h.market GROUP BY 1, 2)""",
           "holdings", "securities", extra=(INDUSTRIES,)))
def industry_weights_ordered(d: Domain) -> DataFrame:
    """Industries of each product, heaviest first, with unset markets filled from the code."""
    rows = holdings.industry_weights(d.holdings(), holdings.security_industries(d.securities()))
    return holdings.with_positions(rows.withColumn("raw_weight", F.round("raw_weight", 9))).select("product_id", "feature", "position")


@query(sql("""SELECT product_id, nav_date, CASE WHEN day(nav_date) % 3 = 0 THEN DATE '2002-01-01'
        WHEN day(nav_date) % 3 = 1 THEN DATE '2002-01-01' ELSE nav_date END AS parsed FROM snapshot_nav""", "snapshot_nav"))
def dates_or_today(d: Domain) -> DataFrame:
    """Dates given as text or by the words for the current day."""
    day = F.dayofmonth("nav_date") % 3
    given = F.when(day == 0, " Today ").when(day == 1, "NOW").otherwise(F.date_format("nav_date", "yyyy-MM-dd"))
    return d.snapshot_nav().select(
        "product_id", "nav_date", parsing.to_date_or_today(given, F.lit(date(2002, 1, 1))).alias("parsed")
    )


@query(sql("""SELECT cluster_run_id, cluster_id, CASE WHEN cluster_id % 3 = 0 THEN 'style ' || CAST(cluster_id AS VARCHAR)
        WHEN cluster_id % 3 = 1 THEN top_industries ELSE '簇 #' || CAST(cluster_id AS VARCHAR) END AS label,
        CASE cluster_id % 3 WHEN 0 THEN 'stored' WHEN 1 THEN 'industries' ELSE 'id' END AS source FROM run_clusters""",
           "run_clusters"))
def cluster_display_labels(d: Domain) -> DataFrame:
    """A stored label goes first, then the one of the industries, then the number; an empty one counts as unset."""
    turn = F.col("cluster_id") % 3
    stored = F.when(turn == 0, F.concat(F.lit("style "), F.col("cluster_id").cast("string"))).when(turn == 1, "")
    derived = F.when(turn != 2, F.col("top_industries"))
    return d.run_clusters().select(
        "cluster_run_id",
        "cluster_id",
        text.display_label(stored, derived, F.col("cluster_id")).alias("label"),
        text.label_source(stored, derived).alias("source"),
    )


@query(sql("""SELECT asset_code, market, asset_name FROM securities WHERE market = 'SZ' AND asset_code = (
    SELECT min(asset_code) FROM securities WHERE market = 'SZ')""", "securities"))
def security_on_market(d: Domain) -> DataFrame:
    first = d.securities().filter("market = 'SZ'").agg(F.min("asset_code")).first()[0]
    return browse.security_info(d.securities(), first, "SZ").select("asset_code", "market", "asset_name")
