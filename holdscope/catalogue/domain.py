"""The analytics tables, derived from the supplied test tables.

The test data holds no fund tables, so each one is derived by a fixed analogy: suppliers are
products, parts are securities, line items are holdings and trades, events are quotes, NAVs
and jobs, orders are product snapshots. ``CTES`` states the same derivations in SQL for the
oracle. Amounts are summed as whole cents, so weights are the same doubles on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.operators.skew import width_of
from holdscope.session import cut_lineage

EVENT_SYMBOLS = {
    "click": "SH000300",
    "error": "SZ399006",
    "purchase": "HSI",
    "signup": "NDX",
    "view": "GOLD",
}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_TYPES = ("equity", "mixed", "fixed_income", "index", "money_market")
EVENTS = ("click", "error", "purchase", "signup", "view")


def case(c: Column, table: dict, otherwise: Column | None = None) -> Column:
    """CASE over literal values."""
    out = reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(table.items()), F)
    return out if otherwise is None else out.otherwise(otherwise)


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


class Domain:
    """Derived tables of one test-data folder; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all cores when the scan has fewer splits than cores, for heavy text work."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    def parts(self) -> DataFrame:
        """Parts with the security code and market their key stands for."""
        key = F.col("p_partkey")
        text = key.cast("string")
        pad = F.when(F.length(text) >= 4, text).otherwise(F.lpad(text, 4, "0"))
        kind = key % 6
        code = (
            F.when(kind == 0, F.concat(F.lit("60"), pad))
            .when(kind == 1, F.concat(F.lit("00"), pad))
            .when(kind == 2, F.concat(F.lit("30"), pad))
            .when(kind == 3, F.concat(F.lit("8"), pad))
            .when(kind == 4, (key + 20000).cast("string"))
            .otherwise(F.translate(text, "0123456789", "ABCDEFGHIJ"))
        )
        market = case(kind, {0: "SH", 1: "SZ", 2: "SZ", 3: "BJ", 4: "HK"}, F.lit("US"))
        return self.raw("part").select(
            "p_partkey", "p_name", "p_type", "p_size", "p_brand",
            code.alias("asset_code"),
            market.alias("market"),
        )

    def securities(self) -> DataFrame:
        industry = F.when(F.col("p_size") % 10 != 0, F.concat("p_brand", F.lit("Ⅱ")))
        return self.parts().select(
            "asset_code", "market", F.col("p_name").alias("asset_name"), industry.alias("industry_name")
        )

    def report_date(self) -> Column:
        """The single report date of the holdings: the last day of the last shipping year."""
        last = self.raw("lineitem").agg(F.max("l_shipdate")).scalar()
        return F.make_date(F.year(last), F.lit(12), F.lit(31))

    def held(self) -> DataFrame:
        """What each product holds, not weighed yet. Rows are dealt by security, in as many tasks as they ask for."""
        lines = self.raw("lineitem")
        cells = (
            lines.repartition(width_of(self.spark, lines.count()), "l_partkey")
            .groupBy("l_suppkey", "l_partkey")
            .agg(F.sum(cents("l_extendedprice")).alias("value"), F.sum("l_quantity").alias("quantity"))
        )
        market = F.when(F.col("p_size") != 7, F.col("market"))
        return cells.join(self.parts(), cells["l_partkey"] == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("product_id"),
            F.col("l_suppkey").alias("report_id"),
            "asset_code",
            F.col("p_name").alias("asset_name"),
            F.when(F.col("p_type") == "ECONOMY", "bond").otherwise("stock").alias("asset_type"),
            market.alias("market"),
            F.col("p_brand").alias("industry_name"),
            "value",
            F.col("quantity").alias("share_quantity"),
            (F.col("p_size") > 25).alias("is_top10"),
            F.when(F.col("p_size") <= 40, F.col("p_size")).alias("sort_order"),
        )

    def holdings(self) -> DataFrame:
        """Holdings with their weights; rows are dealt by product, in as many tasks as they ask for."""
        width = width_of(self.spark, self.raw("lineitem").count())
        total = F.sum("value").over(Window.partitionBy("product_id"))
        weighed = self.held().repartition(width, "product_id").withColumn("total", total)
        return weighed.select(
            "product_id",
            "report_id",
            "asset_code",
            "asset_name",
            "asset_type",
            "market",
            "industry_name",
            (F.col("value") / F.col("total")).alias("weight"),
            (F.col("value") / F.lit(100)).alias("market_value"),
            "share_quantity",
            "is_top10",
            "sort_order",
        ).withColumn("report_date", self.report_date())

    def stored_holdings(self) -> DataFrame:
        """The holdings written once, as the stored table they stand for, for queries that read them repeatedly."""
        return cut_lineage(self.holdings())

    def products(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        key = F.col("s_suppkey")
        kind = key % 4
        code = F.when(key % 10 == 9, key - 9).otherwise(key).cast("string")
        letter = case(kind, {1: "A", 2: "B", 3: "C"}, F.lit(""))
        family = (key % 2).cast("string")
        return (
            s.join(n, s["s_nationkey"] == n["n_nationkey"])
            .join(r, n["n_regionkey"] == r["r_regionkey"])
            .select(
                key.alias("product_id"),
                F.col("n_name").alias("institution_code"),
                F.when(F.col("r_name") == "ASIA", "bank_wm").otherwise("fund_company").alias("institution_type"),
                F.concat(F.lit("P"), code).alias("product_code"),
                F.concat(F.lit("Fund "), F.col("n_name"), F.lit(" "), family, F.lit("x"), letter).alias("product_name"),
                case(F.col("r_name"), {"EUROPE": "mixed", "MIDDLE EAST": "fixed_income"}, F.lit("equity")).alias(
                    "product_type"
                ),
                F.concat(F.lit("L"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("risk_level_standard"),
                F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"),
                F.date_add(F.lit("2001-01-01").cast("date"), (key % 300).cast("int")).alias("collect_date"),
            )
        )

    def members(self) -> DataFrame:
        """Products clustered by their nation."""
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("product_id"), F.col("s_nationkey").alias("cluster_id")
        )

    def quotes(self) -> DataFrame:
        """Daily stock prices: value per unit by part and shipping day."""
        daily = (
            self.raw("lineitem")
            .groupBy("l_partkey", F.to_date("l_shipdate").alias("quote_date"))
            .agg(F.sum(cents("l_extendedprice")).alias("value"), F.sum("l_quantity").alias("quantity"))
        )
        return daily.join(self.parts(), daily["l_partkey"] == F.col("p_partkey")).select(
            F.concat(F.col("market"), F.col("asset_code")).alias("symbol_code"),
            "quote_date",
            (F.col("value").cast("double") / F.col("quantity") / 100.0).alias("close_price"),
        )

    def market_quotes(self) -> DataFrame:
        """Daily index quotes: mean event value by event type and day."""
        t = F.col("event_type")
        region = case(t, {"click": "domestic", "error": "domestic", "purchase": "hk", "signup": "us"}, F.lit("commodity"))
        return (
            self.raw("events")
            .groupBy(t, F.to_date("ts").alias("quote_date"))
            .agg((F.sum(cents("value")).cast("double") / F.count(F.lit(1)) / 100.0).alias("close_price"))
            .select(
                case(t, EVENT_SYMBOLS).alias("symbol_code"),
                F.concat(F.lit("index "), t).alias("symbol_name"),
                region.alias("market_region"),
                F.when(t == "view", "commodity").when(t == "error", "stock").otherwise("index").alias("asset_class"),
                "quote_date",
                "close_price",
            )
        )

    def event_day(self) -> Column:
        """The last day with events."""
        return F.to_date(self.raw("events").agg(F.max("ts")).scalar())

    def fund_snapshots(self) -> DataFrame:
        """Snapshots of event users: one product id per (user, event type), one logical product per user."""
        e, c, n = self.raw("events"), self.raw("customer"), self.raw("nation")
        ids = e.groupBy("user_id", "event_type").agg(F.to_date(F.min("ts")).alias("collect_date"))
        return (
            ids.join(c, ids["user_id"] == c["c_custkey"])
            .join(n, c["c_nationkey"] == n["n_nationkey"])
            .select(
                self._fund_id().alias("product_id"),
                F.col("n_name").alias("institution_code"),
                F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("product_code"),
                F.col("c_name").alias("product_name"),
                F.col("c_mktsegment").alias("segment"),
                "collect_date",
            )
        )

    @staticmethod
    def _fund_id() -> Column:
        turn = F.array_position(F.array(*[F.lit(x) for x in EVENTS]), F.col("event_type"))
        return F.col("user_id") * 10 + turn

    def fund_nav(self) -> DataFrame:
        """NAV of each snapshot and day: the mean event value."""
        return (
            self.raw("events")
            .groupBy("user_id", "event_type", F.to_date("ts").alias("nav_date"))
            .agg(
                (F.sum(cents("value")).cast("double") / F.count(F.lit(1)) / 100.0).alias("unit_nav"),
                F.max("event_id").alias("id"),
            )
            .select(self._fund_id().alias("product_id"), "nav_date", "unit_nav", "id")
        )

    def fund_members(self) -> DataFrame:
        """One member per user (its lowest snapshot id), clustered by market segment."""
        turn = F.array_position(F.array(*[F.lit(x) for x in SEGMENTS]), F.col("segment"))
        return self.fund_snapshots().groupBy("institution_code", "product_code").agg(
            F.min("product_id").alias("product_id"), F.min(turn).cast("int").alias("cluster_id")
        ).select("product_id", "cluster_id")

    def fund_holdings(self) -> DataFrame:
        """Holding totals of the fund members, from the orders of the user."""
        o = self.raw("orders")
        return o.select(
            (F.col("o_custkey") * 10 + 1).alias("product_id"),
            F.col("o_totalprice").alias("market_value"),
            (cents("o_totalprice") % 1000 / F.lit(1000)).alias("weight"),
        )

    def snapshots(self) -> DataFrame:
        """Daily product snapshots: each order is a snapshot of its customer."""
        o, c, n = self.raw("orders"), self.raw("customer"), self.raw("nation")
        segment = dict(zip(SEGMENTS, SEGMENT_TYPES))
        return (
            o.join(c, o["o_custkey"] == c["c_custkey"])
            .join(n, c["c_nationkey"] == n["n_nationkey"])
            .select(
                F.col("o_orderkey").alias("product_id"),
                F.col("n_name").alias("institution_code"),
                F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("product_code"),
                F.col("c_name").alias("product_name"),
                case(F.col("c_mktsegment"), segment).alias("product_type"),
                F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1)).alias("risk_level_standard"),
                F.when(F.col("o_orderstatus") == "F", "inactive").otherwise("active").alias("status"),
                F.to_date("o_orderdate").alias("collect_date"),
            )
        )

    def snapshot_nav(self) -> DataFrame:
        """One NAV per snapshot; open orders have none."""
        return (
            self.raw("orders")
            .filter(F.col("o_orderstatus") != "O")
            .select(
                F.col("o_orderkey").alias("id"),
                F.col("o_orderkey").alias("product_id"),
                F.to_date("o_orderdate").alias("nav_date"),
                F.col("o_totalprice").alias("unit_nav"),
            )
        )

    def snapshot_reports(self) -> DataFrame:
        """Holding report of each snapshot that has line items, dated by its last shipment's quarter."""
        day = F.max("l_shipdate")
        quarter = F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey")
            .agg(
                quarter.alias("report_date"),
                F.count(F.lit(1)).alias("holding_count"),
                (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.lit(100)).alias("top10_weight"),
            )
            .select(
                F.col("l_orderkey").alias("report_id"),
                F.col("l_orderkey").alias("product_id"),
                "report_date",
                F.concat(F.year("report_date").cast("string"), F.lit("Q"), F.quarter("report_date").cast("string")).alias(
                    "report_period"
                ),
                "holding_count",
                "top10_weight",
            )
        )

    def logs(self) -> DataFrame:
        """Job log: each event is a job run."""
        t = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("job_"), (F.col("user_id") % 7).cast("string")).alias("job_name"),
            F.concat(F.lit("I"), (F.col("user_id") % 20).cast("string")).alias("institution_code"),
            F.col("ts").alias("start_time"),
            F.when(t != "view", F.col("ts") + F.make_dt_interval(mins=F.lit(5))).alias("end_time"),
            case(t, {"error": "failed", "view": "running"}, F.lit("success")).alias("status"),
            F.when(t == "error", F.concat(F.lit("failed with "), F.col("props"))).alias("error_message"),
            F.col("ts").alias("created_at"),
        )

    def runs(self) -> DataFrame:
        """Stored runs: one per order year and status."""
        o = self.raw("orders").withColumn("y", F.year("o_orderdate"))
        first = o.agg(F.min("y")).scalar()
        g = o.groupBy("y", "o_orderstatus").agg(
            F.countDistinct("o_orderpriority").cast("int").alias("k"),
            F.countDistinct("o_custkey").alias("n_products"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(cents("o_totalprice")).alias("value"),
            F.max("o_orderdate").alias("created_at"),
        )
        prior = F.concat(F.lit("run-"), (F.col("y") - 1).cast("string"), F.lit("-"), F.col("o_orderstatus"))
        return g.select(
            F.concat(F.lit("run-"), F.col("y").cast("string"), F.lit("-"), F.col("o_orderstatus")).alias("id"),
            F.make_date("y", F.lit(12), F.lit(31)).alias("report_date"),
            F.when(F.col("o_orderstatus") == "F", "kmeans-industry").otherwise("kmeans-asset").alias("algorithm"),
            "k",
            F.lit("equity,mixed").alias("product_type_filter"),
            F.when(F.col("o_orderstatus") != "P", F.col("n_products") / F.col("rows")).alias("silhouette"),
            (F.col("value") / F.lit(100)).alias("inertia"),
            "n_products",
            "created_at",
            F.when(F.col("y") == first, "full").otherwise("incremental").alias("mode"),
            F.when((F.col("y") != first) & (F.col("o_orderstatus") == "O"), prior).alias("baseline_run_id"),
        )

    def _run_orders(self) -> DataFrame:
        o = self.raw("orders")
        year = F.year("o_orderdate").cast("string")
        return o.select(
            F.concat(F.lit("run-"), year, F.lit("-"), F.col("o_orderstatus")).alias("cluster_run_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster_id"),
            F.col("o_custkey").alias("product_id"),
            "o_totalprice",
            F.col("o_orderpriority"),
        )

    def run_clusters(self) -> DataFrame:
        return self._run_orders().groupBy("cluster_run_id", "cluster_id").agg(
            F.countDistinct("product_id").alias("size"), F.min("o_orderpriority").alias("top_industries")
        )

    def run_members(self) -> DataFrame:
        return self._run_orders().groupBy("cluster_run_id", "cluster_id", "product_id").agg(
            F.min("o_totalprice").alias("distance_to_center")
        )

    def run_products(self) -> DataFrame:
        """Products of the stored runs; customers with a low balance are unknown to the product table."""
        c, n = self.raw("customer"), self.raw("nation")
        return c.filter("c_acctbal > 0").join(n, c["c_nationkey"] == n["n_nationkey"]).select(
            F.col("c_custkey").alias("product_id"),
            F.col("n_name").alias("institution_code"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("product_code"),
            F.col("c_name").alias("product_name"),
            F.col("c_mktsegment").alias("product_type"),
        )

    def vectors(self) -> DataFrame:
        """Embeddings as a long feature table."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("product_id"), F.posexplode("embedding").alias("pos", "w")
        ).select(
            "product_id",
            F.format_string("f%02d", F.col("pos")).alias("feature"),
            F.col("w").cast("double").alias("weight"),
            F.col("w").cast("double").alias("raw_weight"),
        )

    def vector_labels(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("product_id"), F.col("label").alias("cluster_id")
        )


# The same derivations in SQL: name -> (names it needs, body).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "parts": ((), """
        SELECT p_partkey, p_name, p_type, p_size, p_brand,
            CASE p_partkey % 6
                WHEN 0 THEN '60' || pad WHEN 1 THEN '00' || pad WHEN 2 THEN '30' || pad
                WHEN 3 THEN '8' || pad WHEN 4 THEN CAST(p_partkey + 20000 AS VARCHAR)
                ELSE translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS asset_code,
            CASE p_partkey % 6 WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' WHEN 2 THEN 'SZ' WHEN 3 THEN 'BJ'
                WHEN 4 THEN 'HK' ELSE 'US' END AS market
        FROM (SELECT *, CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 4 THEN CAST(p_partkey AS VARCHAR)
                  ELSE lpad(CAST(p_partkey AS VARCHAR), 4, '0') END AS pad FROM part)"""),
    "securities": (("parts",), """
        SELECT asset_code, market, p_name AS asset_name,
            CASE WHEN p_size % 10 <> 0 THEN p_brand || 'Ⅱ' END AS industry_name FROM parts"""),
    "holdings": (("parts",), """
        SELECT l_suppkey AS product_id, l_suppkey AS report_id, asset_code, p_name AS asset_name,
            CASE WHEN p_type = 'ECONOMY' THEN 'bond' ELSE 'stock' END AS asset_type,
            CASE WHEN p_size <> 7 THEN market END AS market, p_brand AS industry_name,
            value / total AS weight, value / 100 AS market_value, quantity AS share_quantity,
            p_size > 25 AS is_top10, CASE WHEN p_size <= 40 THEN p_size END AS sort_order,
            (SELECT make_date(CAST(year(max(l_shipdate)) AS INTEGER), 12, 31) FROM lineitem) AS report_date
        FROM (SELECT *, CAST(sum(value) OVER (PARTITION BY l_suppkey) AS BIGINT) AS total
              FROM (SELECT l_suppkey, l_partkey,
                        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value,
                        sum(l_quantity) AS quantity
                    FROM lineitem GROUP BY 1, 2)) c
        JOIN parts ON p_partkey = l_partkey"""),
    "products": ((), """
        SELECT s_suppkey AS product_id, n_name AS institution_code,
            CASE WHEN r_name = 'ASIA' THEN 'bank_wm' ELSE 'fund_company' END AS institution_type,
            'P' || CAST(CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 9 ELSE s_suppkey END AS VARCHAR) AS product_code,
            'Fund ' || n_name || ' ' || CAST(s_suppkey % 2 AS VARCHAR) || 'x' ||
                CASE s_suppkey % 4 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE '' END AS product_name,
            CASE r_name WHEN 'EUROPE' THEN 'mixed' WHEN 'MIDDLE EAST' THEN 'fixed_income' ELSE 'equity' END AS product_type,
            'L' || CAST(n_nationkey % 5 + 1 AS VARCHAR) AS risk_level_standard,
            CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
            DATE '2001-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS collect_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "members": ((), "SELECT s_suppkey AS product_id, s_nationkey AS cluster_id FROM supplier"),
    "quotes": (("parts",), """
        SELECT market || asset_code AS symbol_code, quote_date,
            CAST(value AS DOUBLE) / quantity / 100.0 AS close_price
        FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS quote_date,
                  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS value,
                  sum(l_quantity) AS quantity
              FROM lineitem GROUP BY 1, 2)
        JOIN parts ON p_partkey = l_partkey"""),
    "market_quotes": ((), """
        SELECT CASE event_type WHEN 'click' THEN 'SH000300' WHEN 'error' THEN 'SZ399006'
                WHEN 'purchase' THEN 'HSI' WHEN 'signup' THEN 'NDX' WHEN 'view' THEN 'GOLD' END AS symbol_code,
            'index ' || event_type AS symbol_name,
            CASE event_type WHEN 'click' THEN 'domestic' WHEN 'error' THEN 'domestic' WHEN 'purchase' THEN 'hk'
                WHEN 'signup' THEN 'us' ELSE 'commodity' END AS market_region,
            CASE event_type WHEN 'view' THEN 'commodity' WHEN 'error' THEN 'stock' ELSE 'index' END AS asset_class,
            CAST(ts AS DATE) AS quote_date,
            CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS close_price
        FROM events GROUP BY event_type, CAST(ts AS DATE)"""),
    "fund_ids": ((), """
        SELECT *, user_id * 10 + list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)
            AS product_id FROM events"""),
    "fund_snapshots": (("fund_ids",), """
        SELECT product_id, n_name AS institution_code, 'U' || CAST(user_id AS VARCHAR) AS product_code,
            c_name AS product_name, c_mktsegment AS segment, collect_date
        FROM (SELECT product_id, user_id, CAST(min(ts) AS DATE) AS collect_date FROM fund_ids GROUP BY 1, 2)
        JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "fund_nav": (("fund_ids",), """
        SELECT product_id, CAST(ts AS DATE) AS nav_date,
            CAST(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / count(*) / 100.0 AS unit_nav,
            max(event_id) AS id
        FROM fund_ids GROUP BY 1, 2"""),
    "fund_members": (("fund_snapshots",), """
        SELECT min(product_id) AS product_id, CAST(min(list_position(
            ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], segment)) AS INTEGER) AS cluster_id
        FROM fund_snapshots GROUP BY institution_code, product_code"""),
    "fund_holdings": ((), """
        SELECT o_custkey * 10 + 1 AS product_id, o_totalprice AS market_value,
            (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000 AS weight FROM orders"""),
    "snapshots": ((), """
        SELECT o_orderkey AS product_id, n_name AS institution_code, 'C' || CAST(o_custkey AS VARCHAR) AS product_code,
            c_name AS product_name,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'equity' WHEN 'BUILDING' THEN 'mixed'
                WHEN 'FURNITURE' THEN 'fixed_income' WHEN 'HOUSEHOLD' THEN 'index'
                WHEN 'MACHINERY' THEN 'money_market' END AS product_type,
            'L' || substr(o_orderpriority, 1, 1) AS risk_level_standard,
            CASE WHEN o_orderstatus = 'F' THEN 'inactive' ELSE 'active' END AS status,
            CAST(o_orderdate AS DATE) AS collect_date
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "snapshot_nav": ((), """
        SELECT o_orderkey AS id, o_orderkey AS product_id, CAST(o_orderdate AS DATE) AS nav_date,
            o_totalprice AS unit_nav FROM orders WHERE o_orderstatus <> 'O'"""),
    "snapshot_reports": ((), """
        SELECT l_orderkey AS report_id, l_orderkey AS product_id, report_date,
            CAST(year(report_date) AS VARCHAR) || 'Q' || CAST(quarter(report_date) AS VARCHAR) AS report_period,
            holding_count, top10_weight
        FROM (SELECT l_orderkey,
                  last_day(CAST(date_trunc('quarter', max(l_shipdate)) + INTERVAL 2 MONTH AS DATE)) AS report_date,
                  count(*) AS holding_count,
                  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) / 100 AS top10_weight
              FROM lineitem GROUP BY 1)"""),
    "logs": ((), """
        SELECT event_id AS id, 'job_' || CAST(user_id % 7 AS VARCHAR) AS job_name,
            'I' || CAST(user_id % 20 AS VARCHAR) AS institution_code, ts AS start_time,
            CASE WHEN event_type <> 'view' THEN ts + INTERVAL 5 MINUTE END AS end_time,
            CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'success' END AS status,
            CASE WHEN event_type = 'error' THEN 'failed with ' || props END AS error_message, ts AS created_at
        FROM events"""),
    "runs": ((), """
        SELECT 'run-' || CAST(y AS VARCHAR) || '-' || o_orderstatus AS id, make_date(y, 12, 31) AS report_date,
            CASE WHEN o_orderstatus = 'F' THEN 'kmeans-industry' ELSE 'kmeans-asset' END AS algorithm,
            k, 'equity,mixed' AS product_type_filter,
            CASE WHEN o_orderstatus <> 'P' THEN n_products / n END AS silhouette, value / 100 AS inertia,
            n_products, created_at,
            CASE WHEN y = first_y THEN 'full' ELSE 'incremental' END AS mode,
            CASE WHEN y <> first_y AND o_orderstatus = 'O'
                THEN 'run-' || CAST(y - 1 AS VARCHAR) || '-' || o_orderstatus END AS baseline_run_id
        FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus,
                  CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS k, count(DISTINCT o_custkey) AS n_products,
                  count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value,
                  max(o_orderdate) AS created_at,
                  (SELECT CAST(min(year(o_orderdate)) AS INTEGER) FROM orders) AS first_y
              FROM orders GROUP BY 1, 2)"""),
    "run_orders": ((), """
        SELECT 'run-' || CAST(year(o_orderdate) AS VARCHAR) || '-' || o_orderstatus AS cluster_run_id,
            CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cluster_id, o_custkey AS product_id,
            o_totalprice, o_orderpriority FROM orders"""),
    "run_clusters": (("run_orders",), """
        SELECT cluster_run_id, cluster_id, count(DISTINCT product_id) AS size, min(o_orderpriority) AS top_industries
        FROM run_orders GROUP BY 1, 2"""),
    "run_members": (("run_orders",), """
        SELECT cluster_run_id, cluster_id, product_id, min(o_totalprice) AS distance_to_center
        FROM run_orders GROUP BY 1, 2, 3"""),
    "run_products": ((), """
        SELECT c_custkey AS product_id, n_name AS institution_code, 'C' || CAST(c_custkey AS VARCHAR) AS product_code,
            c_name AS product_name, c_mktsegment AS product_type
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0"""),
    "vectors": ((), """
        SELECT vec_id AS product_id, format('f{:02d}', CAST(i - 1 AS INTEGER)) AS feature,
            CAST(embedding[i] AS DOUBLE) AS weight, CAST(embedding[i] AS DOUBLE) AS raw_weight
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""),
    "vector_labels": ((), "SELECT vec_id AS product_id, label AS cluster_id FROM embeddings"),
}


def sql(body: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """An oracle query: the named derivations (with what they need) as WITH, then the body."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order] + [f"{n} AS ({q.strip()})" for n, q in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
