"""Queries: stored cluster runs and the repeatable writes."""

from __future__ import annotations

import tempfile
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain, sql
from holdscope.catalogue.portfolio import ASSET, CROSS, FAMILY, INDUSTRIES, INDUSTRY, KEPT, MERGE
from holdscope.catalogue.registry import query, rounded
from holdscope.operators import keywords, pages, runs
from holdscope.plans import analysis
from holdscope.schemas import DDL
from holdscope.session import cut_lineage
from holdscope.sources import store, writes
from holdscope.sources.tables import create_table, read_table, write_table

DATE = "DATE '1999-12-31'"


@query(sql("""SELECT id, report_date, algorithm, k, n_products, round(silhouette, 6) AS silhouette, mode FROM runs
    WHERE algorithm = 'kmeans-asset' ORDER BY report_date DESC, created_at DESC, id DESC LIMIT 20""", "runs"))
def run_list(d: Domain) -> DataFrame:
    rows = runs.list_runs(d.runs(), algorithm="kmeans-asset")
    return rounded(rows, "silhouette").select(
        "id", "report_date", "algorithm", "k", "n_products", "silhouette", "mode"
    )


@query(sql(f"""SELECT id, k, created_at FROM runs WHERE report_date = {DATE} AND algorithm = 'kmeans-asset' AND k = 5
    AND product_type_filter = 'equity,mixed' ORDER BY created_at DESC, id DESC LIMIT 1""", "runs"))
def run_by_natural_key(d: Domain) -> DataFrame:
    found = runs.find_run(d.runs(), date(1999, 12, 31), "kmeans-asset", 5, "equity,mixed")
    return found.select("id", "k", "created_at")


MEMBERS = """
    SELECT m.cluster_run_id, m.cluster_id, m.product_id, m.distance_to_center,
        coalesce(p.institution_code, '') AS institution_code, coalesce(p.product_code, '') AS product_code,
        coalesce(p.product_name, '') AS product_name, coalesce(p.product_type, '') AS product_type
    FROM run_members m LEFT JOIN run_products p USING (product_id)"""


@query(sql(MEMBERS, "run_members", "run_products"))
def run_members(d: Domain) -> DataFrame:
    return runs.run_members(d.runs(), d.run_members(), d.run_products())


@query(sql("""SELECT c.cluster_run_id, c.cluster_id, c.size, c.top_industries, r.report_date, r.algorithm, r.k,
        round(r.silhouette, 6) AS silhouette, r.n_products
    FROM run_clusters c JOIN runs r ON r.id = c.cluster_run_id""", "run_clusters", "runs"))
def run_clusters(d: Domain) -> DataFrame:
    return rounded(runs.run_clusters(d.runs(), d.run_clusters()).drop("inertia"), "silhouette")


def _member_order(sort: str, order: str):
    @query(sql(f"""SELECT * FROM ({MEMBERS}) WHERE cluster_run_id = (SELECT max(cluster_run_id) FROM run_members)
        AND cluster_id = 2 ORDER BY {order} LIMIT 50""", "run_members", "run_products"), f"member_list_by_{sort}")
    def run(d: Domain) -> DataFrame:
        last = d.runs().orderBy(F.col("id").desc()).limit(1)
        rows = runs.run_members(last, d.run_members(), d.run_products())
        return runs.member_list(rows, 2, sort, 50)


_member_order("distance", "distance_to_center NULLS LAST, product_id")
_member_order("institution", "institution_code, product_code, product_id")
_member_order("code", "product_code, product_id")


@query(sql("""SELECT m.product_id, m.cluster_run_id, m.cluster_id, m.distance_to_center, c.size AS cluster_size,
        c.top_industries, r.report_date, r.algorithm, r.k, r.product_type_filter, r.created_at
    FROM run_members m JOIN runs r ON r.id = m.cluster_run_id
    JOIN run_clusters c ON c.cluster_run_id = m.cluster_run_id AND c.cluster_id = m.cluster_id""",
           "run_members", "runs", "run_clusters"))
def product_memberships(d: Domain) -> DataFrame:
    return runs.memberships(d.run_members(), d.runs(), d.run_clusters())


@query(sql("""SELECT count(*) AS run_total, count(DISTINCT algorithm) AS algo_total,
        count(DISTINCT report_date) AS date_total,
        (SELECT id FROM runs ORDER BY report_date DESC, created_at DESC, id DESC LIMIT 1) AS latest_run FROM runs""",
           "runs"))
def run_totals(d: Domain) -> DataFrame:
    return runs.run_totals(d.runs())


@query(sql("""SELECT id, algorithm, k, round(silhouette, 6) AS silhouette,
        CAST(greatest(1, trunc(silhouette / (SELECT max(silhouette) FROM runs) * 40)) AS INTEGER) AS bar,
        (SELECT round(max(silhouette), 6) FROM runs) AS max_silhouette, (SELECT max(n_products) FROM runs) AS max_products
    FROM runs WHERE silhouette IS NOT NULL""", "runs"))
def run_comparison(d: Domain) -> DataFrame:
    return rounded(runs.compare_runs(d.runs()), "silhouette", "max_silhouette")


@query(sql("SELECT algorithm, count(*) AS runs FROM runs GROUP BY 1", "runs"))
def runs_by_algorithm(d: Domain) -> DataFrame:
    return runs.runs_by_algorithm(d.runs())


GONE = f"""SELECT id FROM runs WHERE report_date = {DATE} AND algorithm = 'kmeans-asset' AND k = 5
    AND product_type_filter = 'equity,mixed' AND mode = 'incremental'
    AND id NOT IN (SELECT baseline_run_id FROM runs WHERE baseline_run_id IS NOT NULL)"""


def _gone(d: Domain) -> DataFrame:
    return runs.superseded(d.runs(), date(1999, 12, 31), "kmeans-asset", 5, "equity,mixed", "incremental")


@query(sql(GONE, "runs"))
def superseded_runs(d: Domain) -> DataFrame:
    return _gone(d)


@query(sql(f"""SELECT cluster_run_id, count(*) AS members FROM run_members WHERE cluster_run_id NOT IN ({GONE})
    GROUP BY 1""", "run_members", "runs"))
def members_after_replacement(d: Domain) -> DataFrame:
    left = runs.without_runs(d.run_members(), _gone(d))
    return left.groupBy("cluster_run_id").agg(F.count(F.lit(1)).alias("members"))


BASELINES = """SELECT id AS cluster_run_id, report_date, algorithm, k, created_at,
    CASE WHEN id LIKE '%O' THEN 'equity,mixed' END AS product_type_filter,
    CASE WHEN algorithm = 'kmeans-asset' THEN 'asset' ELSE 'industry' END AS feature_type FROM runs"""


def _baselines(d: Domain) -> DataFrame:
    return d.runs().select(
        F.col("id").alias("cluster_run_id"),
        "report_date",
        "algorithm",
        "k",
        "created_at",
        F.when(F.col("id").endswith("O"), "equity,mixed").alias("product_type_filter"),
        F.when(F.col("algorithm") == "kmeans-asset", "asset").otherwise("industry").alias("feature_type"),
    )


@query(sql(f"""SELECT 'filtered' AS which, * FROM (SELECT * FROM ({BASELINES}) WHERE algorithm = 'kmeans-asset' AND
        feature_type = 'asset' AND product_type_filter = 'equity,mixed' ORDER BY created_at DESC, cluster_run_id DESC LIMIT 1)
    UNION ALL SELECT 'unfiltered', * FROM (SELECT * FROM ({BASELINES}) WHERE algorithm = 'kmeans-asset' AND
        feature_type = 'asset' AND product_type_filter IS NULL ORDER BY created_at DESC, cluster_run_id DESC LIMIT 1)""",
           "runs"))
def latest_baselines(d: Domain) -> DataFrame:
    b = _baselines(d)
    one = runs.latest_baseline(b, "kmeans-asset", "equity,mixed", "asset").withColumn("which", F.lit("filtered"))
    two = runs.latest_baseline(b, "kmeans-asset", None, "asset").withColumn("which", F.lit("unfiltered"))
    return one.unionByName(two)


@query(sql(f"SELECT * FROM ({BASELINES}) WHERE algorithm = 'kmeans-industry' AND feature_type = 'industry'", "runs"))
def baseline_list(d: Domain) -> DataFrame:
    return runs.list_baselines(_baselines(d), algorithm="kmeans-industry", feature_type="industry")


# Writes: orders up to a day are stored; a batch re-delivers some of them and adds later ones.
KEYS = ["o_custkey", "o_orderdate"]
STORED = "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < DATE '2000-01-01'"
BATCH = """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderdate,
    o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= DATE '1999-06-01'"""
APPEND = """
    SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn
        FROM batch WHERE o_custkey IS NOT NULL) WHERE rn = 1
        AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.o_custkey = o_custkey_ AND s.o_orderdate = o_orderdate_)
    UNION ALL SELECT * FROM batch WHERE o_custkey IS NULL""".replace("o_custkey_", "q.o_custkey").replace(
    "o_orderdate_", "q.o_orderdate").replace("WHERE o_custkey IS NOT NULL) WHERE", "WHERE o_custkey IS NOT NULL) q WHERE")
WRITE_CTES = dict(extra=(("stored", STORED), ("batch", BATCH)))


def _order_batches(d: Domain) -> tuple[DataFrame, DataFrame]:
    o = d.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    stored = o.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    batch = o.filter(F.col("o_orderdate") >= F.lit("1999-06-01").cast("timestamp_ntz")).withColumns(
        {
            "o_custkey": F.when(F.col("o_orderkey") % 50 != 0, F.col("o_custkey")),
            "o_totalprice": F.col("o_totalprice") + 1,
        }
    )
    return stored, batch


@query(sql(APPEND, **WRITE_CTES))
def append_new_rows(d: Domain) -> DataFrame:
    stored, batch = _order_batches(d)
    return writes.rows_to_append(stored, batch, KEYS, [F.col("o_orderkey")])


@query(sql(f"""SELECT n AS inserted, (SELECT count(*) FROM batch) - n AS skipped FROM (
    SELECT count(*) AS n FROM ({APPEND}))""", **WRITE_CTES))
def append_counts(d: Domain) -> DataFrame:
    stored, batch = _order_batches(d)
    return writes.append_counts(stored, batch, KEYS, [F.col("o_orderkey")])


@query(sql("""
    SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_custkey = s.o_custkey
        AND b.o_orderdate = s.o_orderdate)
    UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate
        ORDER BY o_orderkey DESC) AS rn FROM batch WHERE o_custkey IS NOT NULL) WHERE rn = 1""", **WRITE_CTES))
def upsert_rows(d: Domain) -> DataFrame:
    stored, batch = _order_batches(d)
    known = batch.filter(F.col("o_custkey").isNotNull())
    return writes.upserted(stored, known, KEYS, [F.col("o_orderkey").desc()])


# Round trips through a stored table: one quote per customer and quarter; every order is in one of two batches.
QUOTE_BATCH = """SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quote_date, 'C' || o_custkey AS symbol_code,
    o_orderkey AS seq, CAST(round(o_totalprice, 2) AS DECIMAL(18, 4)) + {add} AS close_price FROM orders WHERE o_orderkey % 2 = {part}"""
FIRST, SECOND = QUOTE_BATCH.format(add=0, part=0), QUOTE_BATCH.format(add=1, part=1)


def _winner(batch: str, order: str) -> str:
    return f"""SELECT quote_date, symbol_code, close_price FROM (SELECT *, row_number() OVER (
        PARTITION BY quote_date, symbol_code ORDER BY seq {order}) AS rn FROM ({batch})) WHERE rn = 1"""


def _quote_batch(d: Domain, part: int, add: int) -> DataFrame:
    return d.raw("orders").filter(F.col("o_orderkey") % 2 == part).select(
        F.col("o_orderkey").alias("id"),
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quote_date"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol_code"),
        F.lit("group").alias("symbol_name"),
        F.lit("domestic").alias("market_region"),
        F.lit("index").alias("asset_class"),
        (F.round("o_totalprice", 2).cast("decimal(18,4)") + add).cast("decimal(18,4)").alias("close_price"),
        F.lit("CNY").alias("currency"),
        F.lit("test").alias("data_source"),
        F.lit(datetime(2002, 1, 1)).cast("timestamp_ntz").alias("created_at"),
    )


def _read_quotes(d: Domain, root: str) -> DataFrame:
    rows = read_table(d.spark, root, "market_quote").select("quote_date", "symbol_code", "close_price")
    return rows.withColumn("close_price", F.col("close_price").cast("double"))


def _as_double(body: str) -> str:
    return f"SELECT quote_date, symbol_code, CAST(close_price AS DOUBLE) AS close_price FROM ({body})"


@query(_as_double(f"""{_winner(FIRST, "ASC")} UNION ALL SELECT * FROM ({_winner(SECOND, "ASC")}) n
    WHERE (quote_date, symbol_code) NOT IN (SELECT (quote_date, symbol_code) FROM ({_winner(FIRST, "ASC")}))"""))
def stored_appends(d: Domain) -> DataFrame:
    """Two batches appended to a stored table, the second one twice: the first row of a key stays."""
    root = store_root(d)
    create_table(d.spark, root, "market_quote")
    store.append_new(root, "market_quote", _quote_batch(d, 0, 0), ["id"])
    for _ in range(2):
        store.append_new(root, "market_quote", _quote_batch(d, 1, 1), ["id"])
    return _read_quotes(d, root)


@query(_as_double(f"""{_winner(SECOND, "DESC")} UNION ALL SELECT * FROM ({_winner(FIRST, "DESC")}) n
    WHERE (quote_date, symbol_code) NOT IN (SELECT (quote_date, symbol_code) FROM ({_winner(SECOND, "DESC")}))"""))
def stored_upserts(d: Domain) -> DataFrame:
    """Two batches upserted into a stored table, the second one twice: the last row of a key wins."""
    root = store_root(d)
    create_table(d.spark, root, "market_quote")
    for part, add in ((0, 0), (1, 1), (1, 1)):
        store.upsert(root, "market_quote", _quote_batch(d, part, add), ["id"])
    return _read_quotes(d, root)


@query(sql("""
    SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_custkey IS NOT DISTINCT FROM s.o_custkey
        AND b.o_orderdate = s.o_orderdate) UNION ALL SELECT * FROM batch""", **WRITE_CTES))
def replace_rows(d: Domain) -> DataFrame:
    stored, batch = _order_batches(d)
    return writes.replaced(stored, batch, KEYS)


NOW = "(SELECT max(ts) FROM events)"


@query(sql(f"""SELECT id, job_name, CASE WHEN stale THEN 'failed' ELSE status END AS status,
        CASE WHEN stale THEN {NOW} ELSE end_time END AS end_time,
        CASE WHEN stale THEN 'marked stale by runner startup' ELSE error_message END AS error_message
    FROM (SELECT *, status = 'running' AND start_time < {NOW} - INTERVAL 30 MINUTE AND job_name = 'job_3' AS stale
          FROM logs)""", "logs"))
def close_stale_jobs(d: Domain) -> DataFrame:
    now = d.raw("events").agg(F.max("ts")).scalar()
    return writes.close_stale(d.logs(), now, 30, "job_3").select(
        "id", "job_name", "status", "end_time", "error_message"
    )


@query(sql(f"""SELECT count(*) AS closed FROM logs WHERE status = 'running' AND start_time < {NOW} - INTERVAL 30 MINUTE""",
           "logs"))
def stale_job_count(d: Domain) -> DataFrame:
    return writes.stale_count(d.logs(), d.raw("events").agg(F.max("ts")).scalar())


@query(sql("""SELECT asset_code, coalesce(market, 'UNKNOWN') AS market, min(asset_name) AS asset_name FROM holdings
    WHERE (asset_code, coalesce(market, 'UNKNOWN')) NOT IN (SELECT (asset_code, market) FROM securities)
    GROUP BY 1, 2""", "holdings", "securities"))
def missing_securities(d: Domain) -> DataFrame:
    rows = writes.security_rows(d.held().withColumn("industry_name", F.lit(None).cast("string")))
    new = writes.rows_to_append(
        d.securities(), rows, ["asset_code", "market"], [F.col("asset_name").asc(), F.col("asset_type").asc()]
    )
    return new.select("asset_code", "market", "asset_name")


def load_store(d: Domain, root: str) -> None:
    """Write the derived tables in the stored layout, so that clustering runs as it would in use."""
    stamp = F.lit(datetime(2002, 1, 1)).cast("timestamp_ntz")
    for table in DDL:
        create_table(d.spark, root, table)
    products = d.products().withColumnRenamed("product_id", "id").withColumns(
        {
            "institution_name": F.col("institution_code"),
            "risk_level": F.lit("R3"),
            "currency": F.lit("CNY"),
            "manager": F.col("institution_code"),
            "data_source": F.lit("test"),
            "created_at": stamp,
            "updated_at": stamp,
        }
    )
    write_table(products, root, "product_info")
    row_id = F.xxhash64("product_id", "asset_code")
    write_table(d.holdings().withColumns({"id": row_id, "created_at": stamp}), root, "product_holding")
    write_table(
        d.securities().withColumns({"id": F.xxhash64("asset_code"), "created_at": stamp, "updated_at": stamp}),
        root,
        "holding_security_info",
    )


ORDERED = "SELECT *, row_number() OVER (ORDER BY institution_code, product_code, product_id) - 1 AS place FROM snapshots"


@query(sql(f"""SELECT place, product_id, institution_code, product_code, product_name FROM ({ORDERED})
    WHERE place >= (SELECT (count(*) - 1) // 40 * 40 FROM snapshots)""", "snapshots"))
def deepest_product_page(d: Domain) -> DataFrame:
    """The last page of all products, read from the one stored range that holds it."""
    path = f"{store_root(d)}/order"
    order = [F.col(c).asc() for c in ("institution_code", "product_code", "product_id")]
    pages.store_order(d.snapshots(), order, path, range_rows=1000)
    found = pages.read_page(d.spark, path, pages.last_page(d.spark, path, 40), 40)
    return found.select("place", "product_id", "institution_code", "product_code", "product_name")


@query(sql("""SELECT product_id, product_code, product_name FROM snapshots
    WHERE product_code ILIKE '%1_5%' OR product_name ILIKE '%1_5%'
    UNION ALL SELECT product_id, product_code, product_name FROM snapshots
    WHERE product_code ILIKE '%c10%' OR product_name ILIKE '%c10%'""", "snapshots"))
def products_by_keyword(d: Domain) -> DataFrame:
    """Two keywords: one of three letters goes by the trigrams, one cut by a wild card reads all rows."""
    columns = ["product_code", "product_name"]
    rows = d.snapshots().select("product_id", *columns)
    index = cut_lineage(keywords.trigram_index(rows, "product_id", columns))
    found = [keywords.search(rows, index, "product_id", columns, k) for k in ("1_5", "C10")]
    return found[0].unionByName(found[1])


FEATURE_COUNTS = ("counts", """
    SELECT 'asset' AS kind, count(DISTINCT product_id) AS n_products, count(DISTINCT feature) AS n_features FROM asset_cells
    UNION ALL SELECT 'industry', count(DISTINCT product_id), count(DISTINCT feature) FROM industry_cells""")


@query(sql("""
    SELECT kind, CAST(turn AS INTEGER) AS turn, CASE turn WHEN 1 THEN 'full' ELSE 'incremental' END AS mode, n_products, n_features,
        turn = 2 AS has_baseline, n_products AS members, n_products AS in_clusters, true AS a_row_per_cluster
    FROM counts, (SELECT unnest([1, 2]) AS turn)""", "holdings", "products", "securities",
    extra=(CROSS, FAMILY, MERGE, KEPT, ASSET, INDUSTRIES, INDUSTRY, FEATURE_COUNTS)))
def auto_incremental_runs(d: Domain) -> DataFrame:
    """Two automatic runs per feature type, as stored: the first searches k in full, the second starts from it."""
    root = store_root(d)
    load_store(d, root)
    day = analysis.latest_report_date(d.spark, root)
    out = []
    for kind in ("asset", "industry"):
        features = analysis.build_features(d.spark, root, day, analysis.Settings(), kind)
        for i in (1, 2):
            now = datetime(2002, 1, i)
            r = analysis.cluster(d.spark, root, day, analysis.Settings(), kind, "auto", now, features)
            out.append((r["cluster_run_id"], kind, i, r["mode"], r["k"], r["n_products"], r["n_features"], r["baseline_run_id"] is not None))
    told = d.spark.createDataFrame(
        out,
        "cluster_run_id STRING, kind STRING, turn INT, mode STRING, k INT, n_products BIGINT, n_features BIGINT, has_baseline BOOLEAN",
    )
    members = read_table(d.spark, root, "similarity_cluster_members").groupBy("cluster_run_id").agg(F.count(F.lit(1)).alias("members"))
    clusters = read_table(d.spark, root, "similarity_clusters").groupBy("cluster_run_id").agg(
        F.sum("size").alias("in_clusters"), F.countDistinct("cluster_id").alias("clusters")
    )
    rows = told.join(members, "cluster_run_id", "left").join(clusters, "cluster_run_id", "left")
    return rows.select(
        "kind", "turn", "mode", "n_products", "n_features", "has_baseline", "members", "in_clusters",
        (F.col("clusters") == F.col("k")).alias("a_row_per_cluster"),
    )


def store_root(d: Domain) -> str:
    """A new folder for stored tables: beside the shared checkpoints, or a temporary one when local."""
    shared = d.spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/holdscope-store-{uuid4().hex}"
    if not d.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="holdscope-store-")
