"""Queries: cross-section, features, similarity, clustering, profiles and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdscope.catalogue.domain import Domain, sql
from holdscope.catalogue.registry import query, rounded
from holdscope.catalogue.series import BASE_MARKET, RETURNS, stock_returns
from holdscope.functions.text import display_label
from holdscope.operators import (
    attribution,
    baseline,
    clustering,
    holdings,
    neighbours,
    profiling,
    returns,
    selection,
    similarity,
    timeseries,
)
from holdscope.operators.skew import width_of
from holdscope.plans.analysis import Settings
from holdscope.session import cut_lineage, discard, materialise

TYPES = ("equity", "mixed")
CROSS = ("cross_rows", """
    SELECT l.product_id, l.product_code, l.product_name, l.institution_code, l.product_type,
        h.asset_code, h.asset_name, h.market, h.weight
    FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY collect_date DESC, product_id DESC) AS rn
          FROM products WHERE product_type IN ('equity', 'mixed')
              AND product_id IN (SELECT product_id FROM holdings)) l
    JOIN holdings h USING (product_id)
    WHERE l.rn = 1 AND h.asset_type = 'stock' AND l.product_id IN (
        SELECT product_id FROM holdings WHERE asset_type = 'stock' GROUP BY 1 HAVING count(DISTINCT asset_code) >= 3)""")
# RE2's \s covers ASCII blanks only; the derived names hold no other white space.
MERGE = ("merge_map", r"""
    SELECT coalesce(k.product_id, f.product_id) AS kept_id, f.product_id AS merged_id
    FROM fam f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_code, family
            ORDER BY n DESC, product_id) AS rn, sum(lettered) OVER (PARTITION BY institution_code, family) AS letters
        FROM fam) WHERE rn = 1 AND letters >= 2) k
        ON k.institution_code = f.institution_code AND k.family = f.family""")
FAMILY = ("fam", r"""
    SELECT institution_code, product_id, trim(regexp_replace(trim(product_name), '(?i)\s?[ABCEH]$', '')) AS family,
        CAST(regexp_matches(trim(product_name), '(?i)\s?[ABCEH]$') AS INTEGER) AS lettered, count(*) AS n
    FROM cross_rows GROUP BY 1, 2, 3, 4""")
KEPT = ("kept_rows", "SELECT * FROM cross_rows WHERE product_id IN (SELECT kept_id FROM merge_map)")
ASSET = ("asset_cells", """
    SELECT *, raw_weight / sqrt(sum(raw_weight * raw_weight) OVER (PARTITION BY product_id)) AS weight FROM (
        SELECT product_id, asset_code AS feature, sum(weight) AS raw_weight FROM kept_rows
        WHERE asset_code IS NOT NULL GROUP BY 1, 2)""")
INDUSTRIES = ("industries", f"""
    SELECT asset_code, market, industry_name FROM (SELECT *, row_number() OVER (PARTITION BY asset_code, market
        ORDER BY r, industry_name) AS rn FROM (
        SELECT asset_code, market, industry_name, 0 AS r FROM securities WHERE industry_name IS NOT NULL
        UNION ALL SELECT asset_code, inferred, industry_name, 1 FROM (
            SELECT *, {BASE_MARKET.replace("code", "asset_code")} AS inferred FROM securities
            WHERE industry_name IS NOT NULL) WHERE inferred <> market)) WHERE rn = 1""")
INDUSTRY = ("industry_cells", """
    SELECT *, raw_weight / sqrt(sum(raw_weight * raw_weight) OVER (PARTITION BY product_id)) AS weight FROM (
        SELECT product_id, coalesce(industry_name, '未知行业') AS feature, sum(weight) AS raw_weight
        FROM kept_rows k LEFT JOIN industries i ON i.asset_code = k.asset_code AND i.market = k.market
        WHERE k.market IS NOT NULL GROUP BY 1, 2)""")
FEATURES = dict(extra=(CROSS, FAMILY, MERGE, KEPT, ASSET))
INDUSTRY_FEATURES = dict(extra=(CROSS, FAMILY, MERGE, KEPT, INDUSTRIES, INDUSTRY))


def cross_rows(d: Domain) -> DataFrame:
    return holdings.cross_section(d.products(), d.stored_holdings(), d.report_date(), TYPES)


def asset_features(d: Domain) -> tuple[DataFrame, DataFrame]:
    return holdings.features(cross_rows(d))


def industry_features(d: Domain) -> tuple[DataFrame, DataFrame]:
    return holdings.features(cross_rows(d), "industry", holdings.security_industries(d.securities()))


@query(sql("SELECT * REPLACE (round(weight, 6) AS weight) FROM cross_rows", "holdings", "products", extra=(CROSS,)))
def holdings_cross_section(d: Domain) -> DataFrame:
    return rounded(cross_rows(d), "weight")


@query(sql("SELECT kept_id, merged_id FROM merge_map", "holdings", "products", extra=(CROSS, FAMILY, MERGE)))
def share_class_map(d: Domain) -> DataFrame:
    return holdings.share_class_map(cross_rows(d))


@query(sql("""SELECT product_id, feature, round(raw_weight, 6) AS raw_weight, round(weight, 6) AS weight
    FROM asset_cells""", "holdings", "products", **FEATURES))
def weight_features_asset(d: Domain) -> DataFrame:
    return rounded(asset_features(d)[0], "raw_weight", "weight")


@query(sql("""SELECT product_id, feature, round(raw_weight, 6) AS raw_weight, round(weight, 6) AS weight
    FROM industry_cells""", "holdings", "products", "securities", **INDUSTRY_FEATURES))
def weight_features_industry(d: Domain) -> DataFrame:
    return rounded(industry_features(d)[0], "raw_weight", "weight")


# The classification of the parts, and the bucket of those without one.
MATRIX = [*[f"Brand#{i}Ⅱ" for i in range(1, 26)], "未知行业"]


@query(sql("SELECT product_id, " + ", ".join(
    f"""round(coalesce(sum(CASE WHEN feature = '{m}' THEN raw_weight END), 0), 6) AS "{m}" """ for m in MATRIX)
    + " FROM industry_cells GROUP BY 1", "holdings", "products", "securities", **INDUSTRY_FEATURES))
def weight_matrix_export(d: Domain) -> DataFrame:
    """Wide export of all industries for all products."""
    return rounded(holdings.to_matrix(industry_features(d)[0], MATRIX), *MATRIX)


@query(sql("""SELECT product_id, round(sum(raw_weight * raw_weight), 6) AS hhi FROM asset_cells GROUP BY 1""",
           "holdings", "products", **FEATURES))
def concentration_hhi(d: Domain) -> DataFrame:
    return rounded(holdings.concentration(asset_features(d)[0]), "hhi")


@query(sql("SELECT asset_code, market, industry_name FROM industries", "securities", extra=(INDUSTRIES,)))
def security_industries(d: Domain) -> DataFrame:
    return holdings.security_industries(d.securities())


# A refresh: the mapping knows other codes and markets than the stored rows.
STORED = ("stored", """
    SELECT CASE WHEN p_size % 3 = 0 AND market = 'HK' THEN substr(asset_code, 2) ELSE asset_code END AS asset_code,
        CASE WHEN p_size % 4 = 0 THEN '' ELSE market END AS market,
        CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_brand || 'Ⅱ' END AS industry_name FROM parts""")
MAPPING = ("mapping", """
    SELECT CASE WHEN market = 'HK' THEN '0' || substr(asset_code, 2) ELSE asset_code END AS asset_code, market,
        p_brand || 'Ⅱ' AS industry_name FROM parts WHERE p_size % 7 <> 0""")
RESOLVED = ("resolved", f"""
    SELECT s.asset_code, s.market, s.industry_name, coalesce(a.industry_name, b.industry_name, c.industry_name) AS found
    FROM (SELECT *, {BASE_MARKET.replace("code", "asset_code")} AS inferred FROM stored) s
    LEFT JOIN mapping a ON a.asset_code = s.asset_code AND a.market = CASE WHEN s.market = '' THEN s.inferred ELSE s.market END
    LEFT JOIN mapping b ON b.asset_code = s.asset_code AND b.market = s.inferred
    LEFT JOIN mapping c ON c.asset_code = '0' || s.asset_code AND c.market = 'HK' AND length(s.asset_code) = 4
        AND CASE WHEN s.market = '' THEN s.inferred ELSE s.market END = 'HK'""")


def _resolved(d: Domain) -> DataFrame:
    parts = d.parts()
    hk = F.col("market") == "HK"
    size, brand = F.col("p_size"), F.col("p_brand")
    short = F.substring("asset_code", 2, 100)
    stored = parts.select(
        F.when((size % 3 == 0) & hk, short).otherwise(F.col("asset_code")).alias("asset_code"),
        F.when(size % 4 == 0, "").otherwise(F.col("market")).alias("market"),
        F.when(size % 5 == 0, brand).otherwise(F.concat(brand, F.lit("Ⅱ"))).alias("industry_name"),
    )
    mapping = parts.filter("p_size % 7 <> 0").select(
        F.when(hk, F.concat(F.lit("0"), short)).otherwise(F.col("asset_code")).alias("asset_code"),
        "market",
        F.concat(brand, F.lit("Ⅱ")).alias("industry_name"),
    )
    return holdings.resolved_industries(stored, mapping)


@query(sql("""SELECT asset_code, market, industry_name, coalesce(found, industry_name) AS new_industry,
        CASE WHEN found IS NULL THEN 'missing' WHEN found IS NOT DISTINCT FROM industry_name THEN 'unchanged'
            ELSE 'updated' END AS outcome FROM resolved""", "parts", extra=(STORED, MAPPING, RESOLVED)))
def industry_resolution(d: Domain) -> DataFrame:
    return _resolved(d)


@query(sql("""SELECT count(*) AS total, count(CASE WHEN found IS DISTINCT FROM industry_name THEN found END) AS updated,
        count(CASE WHEN found IS NOT DISTINCT FROM industry_name THEN found END) AS unchanged,
        count(*) - count(found) AS missing FROM resolved""", "parts", extra=(STORED, MAPPING, RESOLVED)))
def industry_update_counts(d: Domain) -> DataFrame:
    return holdings.industry_update_counts(_resolved(d))


TARGET = "(SELECT product_id FROM asset_cells GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
PAIRED = f"""
    SELECT x.product_id, t.feature AS hit, x.{{w}} AS w, t.{{w}} AS t FROM asset_cells x
    LEFT JOIN (SELECT * FROM asset_cells WHERE product_id = {TARGET}) t USING (feature)
    WHERE x.product_id <> {TARGET}"""
SCORES = {
    "overlap": "coalesce(sum(CASE WHEN t IS NULL THEN 0 ELSE least(w, t) END), 0)",
    "cosine": f"""coalesce(sum(w * t), 0) / sqrt(sum(w * w)) / (SELECT sqrt(sum(weight * weight)) FROM asset_cells
        WHERE product_id = {TARGET})""",
    "jaccard": f"""count(hit) / (count(*) + (SELECT count(*) FROM asset_cells WHERE product_id = {TARGET}) - count(hit))""",
}


def _neighbors(metric: str):
    column = similarity.METRIC_COLUMN[metric]
    oracle = sql(f"""SELECT product_id, '{metric}' AS metric, round(s, 6) AS score FROM (
        SELECT product_id, CAST({SCORES[metric]} AS DOUBLE) AS s FROM ({PAIRED.format(w=column)}) GROUP BY 1)
        ORDER BY round(s, 12) DESC, 1 LIMIT 10""", "holdings", "products", **FEATURES)

    @query(oracle, f"neighbors_{metric}")
    def run(d: Domain) -> DataFrame:
        cells = cut_lineage(asset_features(d)[0])
        widest = cells.groupBy("product_id").count().orderBy(F.col("count").desc(), "product_id").first()
        return rounded(similarity.neighbors(cells, widest["product_id"], metric, 10), "score")


for _metric in similarity.METRICS:
    _neighbors(_metric)

# All holdings of all products, clustered by nation.
CELLS = ("cells", """
    SELECT *, raw_weight / sqrt(sum(raw_weight * raw_weight) OVER (PARTITION BY product_id)) AS weight FROM (
        SELECT product_id, asset_code AS feature, sum(weight) AS raw_weight FROM holdings GROUP BY 1, 2)""")


def all_cells(d: Domain) -> DataFrame:
    return cells_of(d.holdings())


def cells_of(held: DataFrame) -> DataFrame:
    return holdings.l2_normalised(holdings.asset_cells(held))


def dealt_by_product(d: Domain, held: DataFrame) -> DataFrame:
    """Holdings that were read from files, in as many tasks as they ask for; sums and norms of a product need no other shuffle."""
    return held.repartition(width_of(d.spark, held.count()), "product_id")


@query(sql("""SELECT m.cluster_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(max(p.s), 0) /
        (count(*) * (count(*) - 1) / 2) END, 6) AS avg_overlap
    FROM members m LEFT JOIN (
        SELECT a.cluster_id, sum(least(a.raw_weight, b.raw_weight)) AS s
        FROM (SELECT c.*, m.cluster_id FROM cells c JOIN members m USING (product_id)) a
        JOIN (SELECT c.*, m.cluster_id FROM cells c JOIN members m USING (product_id)) b
            ON a.cluster_id = b.cluster_id AND a.feature = b.feature AND a.product_id < b.product_id
        GROUP BY 1) p USING (cluster_id) GROUP BY 1""", "holdings", "members", extra=(CELLS,)))
def mean_pairwise_overlap(d: Domain) -> DataFrame:
    return rounded(similarity.mean_pairwise_overlap(all_cells(d), d.members()), "avg_overlap")


# Brinson attribution, stated with the full product x industry grid.
PRICED = ("priced", """
    SELECT m.cluster_id, h.product_id, h.asset_code, h.market, h.weight, r.stock_return,
        coalesce(i.industry_name, '未知行业') AS industry
    FROM holdings h JOIN members m USING (product_id) JOIN returns r ON r.symbol_code = h.market || h.asset_code
    LEFT JOIN industries i ON i.asset_code = h.asset_code AND i.market = h.market
    WHERE h.asset_type = 'stock'""")
PORTFOLIO = ("portfolio", """
    SELECT cluster_id, product_id, industry, w / sum(w) OVER (PARTITION BY product_id) AS wp, wr / w AS rp FROM (
        SELECT cluster_id, product_id, industry, sum(weight) AS w, sum(weight * stock_return) AS wr FROM priced GROUP BY 1, 2, 3)""")
POOLED = ("bench", """
    SELECT cluster_id, industry, w / sum(w) OVER (PARTITION BY cluster_id) AS wb, wr / w AS rb FROM (
        SELECT cluster_id, industry, sum(weight) AS w, sum(weight * stock_return) AS wr FROM priced GROUP BY 1, 2)""")
INDEX = ("index_weights", """
    SELECT asset_code, market, CAST(v AS DOUBLE) / 1e9 AS weight FROM (
        SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1)
    JOIN parts ON p_partkey = l_partkey WHERE p_size <= 20""")
INDEX_BENCH = ("bench", """
    SELECT c.cluster_id, industry, wb, rb FROM (SELECT DISTINCT cluster_id FROM priced) c, (
        SELECT industry, w / sum(w) OVER () AS wb, wr / w AS rb FROM (
            SELECT coalesce(i.industry_name, '未知行业') AS industry, sum(x.weight) AS w,
                sum(x.weight * r.stock_return) AS wr
            FROM index_weights x JOIN returns r ON r.symbol_code = x.market || x.asset_code
            LEFT JOIN industries i ON i.asset_code = x.asset_code AND i.market = x.market GROUP BY 1))""")
BRINSON = """
    SELECT cluster_id, product_id, round(total_return, 6) AS total_return, round(benchmark_return, 6) AS benchmark_return,
        round(total_return - benchmark_return, 6) AS excess_return, round(allocation_effect, 6) AS allocation_effect,
        round(selection_effect, 6) AS selection_effect, round(interaction_effect, 6) AS interaction_effect,
        row_number() OVER (PARTITION BY cluster_id ORDER BY total_return - benchmark_return DESC, product_id) AS rank_in_cluster
    FROM (SELECT cluster_id, product_id, sum(wp * rp) AS total_return, sum(wb * rb) AS benchmark_return,
              sum((wp - wb) * rb) AS allocation_effect, sum(wb * (rp - rb)) AS selection_effect,
              sum((wp - wb) * (rp - rb)) AS interaction_effect
          FROM (SELECT g.cluster_id, g.product_id, b.wb, b.rb, coalesce(p.wp, 0) AS wp,
                    CASE WHEN coalesce(p.wp, 0) = 0 THEN b.rb ELSE p.rp END AS rp
                FROM (SELECT DISTINCT cluster_id, product_id FROM portfolio) g JOIN bench b USING (cluster_id)
                LEFT JOIN portfolio p ON p.product_id = g.product_id AND p.industry = b.industry)
          GROUP BY 1, 2)"""
BRINSON_CTES = (INDUSTRIES, ("returns", RETURNS), PRICED, PORTFOLIO)
EFFECTS = (
    "total_return", "benchmark_return", "excess_return", "allocation_effect", "selection_effect", "interaction_effect",
)


def _brinson(d: Domain, benchmark: DataFrame | None = None) -> DataFrame:
    industries = holdings.security_industries(d.securities())
    return attribution.brinson(d.members(), d.stored_holdings(), industries, stock_returns(d), benchmark)


@query(sql(BRINSON, "holdings", "members", "quotes", "securities", extra=(*BRINSON_CTES, POOLED)))
def brinson_by_cluster(d: Domain) -> DataFrame:
    return rounded(_brinson(d), *EFFECTS)


def index_constituents(d: Domain) -> DataFrame:
    """A benchmark index: all small-sized parts, weighted by traded value, on two dates."""
    traded = d.raw("lineitem").groupBy("l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("v")
    )
    rows = traded.join(d.parts(), F.col("l_partkey") == F.col("p_partkey"))
    day = F.lit("2001-12-31").cast("date")
    both = rows.select(
        F.lit("000300").alias("index_code"),
        F.col("asset_code").alias("constituent_code"),
        "market",
        (F.col("v").cast("double") / 1e9).alias("weight"),
        F.when(F.col("p_size") <= 20, day).otherwise(F.date_sub(day, 31)).alias("effective_date"),
    )
    return attribution.index_weights(both, "000300")


@query(sql(BRINSON, "holdings", "members", "quotes", "securities", "parts", extra=(*BRINSON_CTES, INDEX, INDEX_BENCH)))
def brinson_index_benchmark(d: Domain) -> DataFrame:
    return rounded(_brinson(d, index_constituents(d)), *EFFECTS)


@query(sql("""SELECT cluster_id, count(DISTINCT product_id) AS n_products FROM portfolio GROUP BY 1""",
           "holdings", "members", "quotes", "securities", extra=BRINSON_CTES))
def attribution_totals(d: Domain) -> DataFrame:
    return attribution.attribution_totals(_brinson(d))


@query(sql("""SELECT symbol_code, industry FROM (SELECT symbol_code, industry, row_number() OVER (
        PARTITION BY symbol_code ORDER BY count(*) DESC, industry) AS rn
    FROM (SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol_code, event_type AS industry FROM events)
    GROUP BY 1, 2) WHERE rn = 1"""))
def modal_industry(d: Domain) -> DataFrame:
    rows = d.raw("events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol_code"), F.col("event_type").alias("industry")
    )
    return returns.symbol_industry(rows)


# Clustering of the embedding vectors: labels give the starting centroids.
MEANS = ("means", """
    SELECT cluster_id, feature, sum(weight) / max(n) AS value FROM vectors JOIN vector_labels USING (product_id)
    JOIN (SELECT cluster_id, count(*) AS n FROM vector_labels GROUP BY 1) USING (cluster_id) GROUP BY 1, 2""")


def assign_sql(name: str, centroids: str) -> tuple[str, str]:
    """Nearest centroid of every vector; the lowest cluster id wins a tie."""
    return name, f"""SELECT product_id, cluster_id, d2 FROM (SELECT product_id, cluster_id, d2, row_number() OVER (
        PARTITION BY product_id ORDER BY d2, cluster_id) AS rn FROM (
        SELECT v.product_id, c.cluster_id, sum((v.weight - c.value) * (v.weight - c.value)) AS d2
        FROM vectors v JOIN {centroids} c USING (feature) GROUP BY 1, 2)) WHERE rn = 1"""


def update_sql(name: str, labels: str, old: str) -> tuple[str, str]:
    """Mean vector of every cluster; an empty one keeps its centre."""
    return name, f"""SELECT o.cluster_id, o.feature, coalesce(n.value, o.value) AS value FROM {old} o LEFT JOIN (
        SELECT cluster_id, feature, avg(weight) AS value FROM vectors JOIN {labels} USING (product_id) GROUP BY 1, 2) n
        USING (cluster_id, feature)"""


def label_start(d: Domain) -> tuple[DataFrame, DataFrame, int]:
    """Vectors, wide centroids of their labels, and the number of labels."""
    v, labels = d.vectors(), d.vector_labels()
    k = labels.agg(F.max("cluster_id")).first()[0] + 1
    means = clustering.label_means(v, labels)
    return v, cut_lineage(clustering.wide_centroids(means, k)), k


@query(sql("SELECT product_id, cluster_id, round(d2, 6) AS d2 FROM l1", "vectors", "vector_labels",
           extra=(MEANS, assign_sql("l1", "means"))))
def kmeans_assign(d: Domain) -> DataFrame:
    v, wide, k = label_start(d)
    return rounded(clustering.assign(v, wide, *clustering.measured(wide, k)), "d2")


# Whole k-means runs by recursion: a state row per k and round, with the centres as a list of vectors.
VECS = ("vecs", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings")


def draw_sql(seed: int, turn: int) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:{turn}:' || id), 1, 13) AS BIGINT) + 1) / 4503599627370496.0"


def plus_plus_sql(seed: int, k: int) -> list[tuple[str, str]]:
    """The products drawn, ``p0`` to ``p{k-1}``, with the squared distances to the nearest so far."""
    out = [
        ("p0", f"SELECT id, x FROM vecs ORDER BY {draw_sql(seed, 0)}, id LIMIT 1"),
        ("d0", "SELECT v.id, v.x, list_distance(v.x, p.x) ** 2 AS d2 FROM vecs v, p0 p"),
    ]
    for t in range(1, k):
        u = draw_sql(seed, t)
        key = f"d2 <= 0, CASE WHEN d2 > 0 THEN -ln({u}) / d2 ELSE {u} END, id"
        out.append((f"p{t}", f"SELECT id, x FROM d{t - 1} ORDER BY {key} LIMIT 1"))
        out.append((f"d{t}", f"SELECT v.id, v.x, least(v.d2, list_distance(v.x, p.x) ** 2) AS d2 FROM d{t - 1} v, p{t} p"))
    return out


def picked_sql(ks: list[int]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS k, [{', '.join(f'(SELECT x FROM p{t})' for t in range(k))}] AS c" for k in ks)


def lloyd_sql(parts: list[tuple[str, str]], starts: str, body: str, empty: str = "far", tol: float = 1e-4, rounds: int = 100) -> str:
    """``body`` over ``last`` (k, it, c, new) and ``labels`` (k, it, id, cluster_id, d2) of runs from ``starts`` (k, c).

    A cluster without members gets ``empty``: ``far``, the vector farthest from all centres, or ``c[j]``, its old centre.
    """
    loops = f"""SELECT k, 0 AS it, c, c AS old, 1e9 AS moved FROM ({starts}) UNION ALL
        SELECT k, it + 1, m, c, sqrt(list_sum(list_transform(range(1, len(c) + 1), lambda j: list_distance(m[j], c[j]) ** 2)))
        FROM (SELECT k, it, c, list_transform(range(1, len(c) + 1), lambda j: coalesce(means[j], {empty})) AS m FROM (
            SELECT k, it, any_value(c) AS c, map_from_entries(list((j, m))) AS means, arg_max(far, top) AS far FROM (
                SELECT k, it, j, any_value(c) AS c, list(a ORDER BY i) AS m, arg_max(far, top) AS far, max(top) AS top FROM (
                    SELECT k, it, j, i, any_value(c) AS c, avg(x[i]) AS a, arg_max(x, low) AS far, max(low) AS top FROM (
                        SELECT k, it, c, x, list_position(ds, list_min(ds)) AS j, list_min(ds) AS low,
                            unnest(range(1, len(x) + 1)) AS i
                        FROM (SELECT l.k, l.it, l.c, v.x, list_transform(l.c, lambda y: list_distance(v.x, y)) AS ds
                              FROM loops l, vecs v WHERE l.moved >= {tol} AND l.it < {rounds}))
                    GROUP BY k, it, j, i) GROUP BY k, it, j) GROUP BY k, it))"""
    last = "SELECT k, it, old AS c, c AS new FROM loops QUALIFY row_number() OVER (PARTITION BY k ORDER BY it DESC) = 1"
    labels = """SELECT k, it, id, list_position(ds, list_min(ds)) - 1 AS cluster_id, list_min(ds) ** 2 AS d2 FROM (
        SELECT l.k, l.it, v.id, list_transform(l.c, lambda y: list_distance(v.x, y)) AS ds FROM last l, vecs v)"""
    named = [VECS, *parts, ("loops", loops), ("last", last), ("labels", labels)]
    ctes = [f"{n} AS {'' if n == 'loops' else 'MATERIALIZED '}({b})" for n, b in named]
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + body


WARM = "SELECT max(cluster_id) + 1 AS k, list(m ORDER BY cluster_id) AS c FROM label_means"
LABEL_MEANS = ("label_means", """SELECT cluster_id, list(a ORDER BY i) AS m FROM (
    SELECT label AS cluster_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS a
    FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")


@query(lloyd_sql([LABEL_MEANS], WARM, """SELECT CAST(j - 1 AS INTEGER) AS cluster_id, format('f{:02d}', CAST(i - 1 AS INTEGER))
    AS feature, round(new[j][i], 6) AS value FROM (SELECT new, j, unnest(range(1, len(new[j]) + 1)) AS i
    FROM (SELECT new, unnest(range(1, len(new) + 1)) AS j FROM last))""", "c[j]"))
def kmeans_warm_centroids(d: Domain) -> DataFrame:
    v, wide, k = label_start(d)
    result = clustering.kmeans_from(v, wide, k)
    return rounded(clustering.long_centroids(result.centroids, k), "value")


@query(lloyd_sql([LABEL_MEANS], WARM, "SELECT max(it) AS n_iter, round(sum(d2), 6) AS inertia FROM labels", "c[j]"))
def kmeans_warm_inertia(d: Domain) -> DataFrame:
    v, wide, k = label_start(d)
    result = clustering.kmeans_from(v, wide, k)
    return d.spark.createDataFrame([(result.n_iter, round(result.inertia, 6))], "n_iter INT, inertia DOUBLE")


SIZES = """SELECT CAST(cluster_id AS INTEGER) AS cluster_id, count(*) AS size, round(sum(d2), 6) AS inertia
    FROM labels GROUP BY 1"""


def _cluster_sizes(result: clustering.Clustering) -> DataFrame:
    found = result.labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum("d2").alias("inertia"))
    return rounded(found, "inertia")


@query(lloyd_sql(plus_plus_sql(42, 4), picked_sql([4]), SIZES))
def kmeans_full(d: Domain) -> DataFrame:
    return _cluster_sizes(clustering.kmeans(d.vectors(), 4))


@query(lloyd_sql([], f"SELECT 4 AS k, list(x ORDER BY u, id) AS c FROM (SELECT *, {draw_sql(7, 0)} AS u FROM vecs ORDER BY u, id LIMIT 4)",
                 SIZES))
def kmeans_random_start(d: Domain) -> DataFrame:
    return _cluster_sizes(clustering.kmeans(d.vectors(), 4, seed=7, init="random"))


@query(sql("""SELECT d.product_id, d.cluster_id, round(sqrt(sum((v.weight - m.value) * (v.weight - m.value))), 6)
        AS distance_to_center
    FROM vector_labels d JOIN vectors v USING (product_id)
    JOIN means m ON m.cluster_id = d.cluster_id AND m.feature = v.feature GROUP BY 1, 2""",
           "vectors", "vector_labels", extra=(MEANS,)))
def member_distances(d: Domain) -> DataFrame:
    v, wide, k = label_start(d)
    return rounded(clustering.member_distances(v, d.vector_labels(), wide, k), "distance_to_center")


@query(sql("""
    SELECT CAST(i AS INTEGER) AS bin_index, format('{:.3f}-{:.3f}', lo + i * step, lo + (i + 1) * step) AS bin,
        (SELECT count(*) FROM dist WHERE least(CAST(floor((x - lo) / step) AS BIGINT), 9) = i) AS count
    FROM (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS step FROM dist), range(10) t(i)""",
           "vectors", "vector_labels", extra=(MEANS, ("dist", """
    SELECT d.product_id, sqrt(sum((v.weight - m.value) * (v.weight - m.value))) AS x
    FROM vector_labels d JOIN vectors v USING (product_id)
    JOIN means m ON m.cluster_id = d.cluster_id AND m.feature = v.feature GROUP BY 1"""))))
def distance_histogram(d: Domain) -> DataFrame:
    v, wide, k = label_start(d)
    rows = cut_lineage(clustering.member_distances(v, d.vector_labels(), wide, k))
    return timeseries.distance_histogram(rows, "distance_to_center")


@query(sql("""
    SELECT round(avg(CASE WHEN greatest(a, b) <> 0 THEN (b - a) / greatest(a, b) END), 6) AS silhouette FROM (
        SELECT product_id, coalesce(max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END), 0) AS a,
            min(CASE WHEN own <> other THEN s / n END) AS b
        FROM (SELECT p.i AS product_id, x.cluster_id AS own, y.cluster_id AS other, sum(p.dist) AS s, count(*) AS n
              FROM (SELECT a.vec_id AS i, b.vec_id AS j,
                        list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
                    FROM embeddings a, embeddings b) p
              JOIN vector_labels x ON x.product_id = p.i JOIN vector_labels y ON y.product_id = p.j GROUP BY 1, 2, 3)
        GROUP BY 1)""", "vector_labels"))
def silhouette_by_label(d: Domain) -> DataFrame:
    return rounded(selection.silhouettes(d.vectors(), [d.vector_labels()]), "silhouette").select("silhouette")


K_SEARCH = lloyd_sql(plus_plus_sql(42, 12), picked_sql(list(range(3, 13))), """,
    dist AS MATERIALIZED (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM vecs a, vecs b),
    sums AS (SELECT x.k, i, x.cluster_id AS own, y.cluster_id AS other, sum(d) AS s, count(*) AS n
        FROM dist JOIN labels x ON x.id = i JOIN labels y ON y.id = j AND y.k = x.k GROUP BY ALL),
    scores AS (SELECT k, avg(CASE WHEN greatest(a, b) <> 0 THEN (b - a) / greatest(a, b) END) AS silhouette FROM (
        SELECT k, i, coalesce(max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END), 0) AS a,
            min(CASE WHEN own <> other THEN s / n END) AS b FROM sums GROUP BY 1, 2) GROUP BY 1),
    searched AS (SELECT k, max(it) AS n_iter, sum(d2) AS inertia, any_value(silhouette) AS silhouette
        FROM labels JOIN scores USING (k) GROUP BY 1),
    curved AS (SELECT *, coalesce(2 * ln(inertia) - lag(ln(inertia)) OVER w - lead(ln(inertia)) OVER w, 0) AS curvature
        FROM searched WINDOW w AS (ORDER BY k)),
    scaled AS (SELECT *, (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ()) AS sn,
        (curvature - min(curvature) OVER ()) / (max(curvature) OVER () - min(curvature) OVER ()) AS cn FROM curved)
    SELECT CAST(k AS INTEGER) AS k, round(inertia, 6) AS inertia, round(silhouette, 6) AS silhouette, n_iter,
        round(curvature, 6) AS curvature, round(sn, 6) AS silhouette_norm, round(cn, 6) AS curvature_norm,
        round(sn + 0.3 * cn, 6) AS composite FROM scaled""").replace(") ,", "),")


@query(K_SEARCH)
def k_search_composite(d: Domain) -> DataFrame:
    s = Settings()
    table, _ = selection.search_k(
        d.vectors(), range(s.k_min, s.k_max + 1), seed=s.random_seed, max_iter=s.max_iter, tol=s.tol
    )
    scored = selection.composite_scores(table, s.elbow_weight)
    return rounded(scored, "inertia", "silhouette", "curvature", "silhouette_norm", "curvature_norm", "composite")


ALL_SCORES = {
    "overlap": "sum(least(a.raw_weight, b.raw_weight))",
    "cosine": "sum(a.weight * b.weight)",
    "jaccard": "count(b.feature) * 1.0 / (max(a.n) + max(b.n) - count(b.feature))",
}


def _neighbors_of_all(metric: str):
    """The five nearest of every product; the oracle scores all pairs."""
    oracle = sql(f"""
        SELECT product_id, CAST(rn AS INTEGER) AS rank, neighbor_id, round(score, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score DESC, neighbor_id) AS rn FROM (
                SELECT p.product_id, q.product_id AS neighbor_id, round(coalesce(s.score, 0), 9) AS score
                FROM (SELECT DISTINCT product_id FROM cells) p JOIN (SELECT DISTINCT product_id FROM cells) q
                    ON p.product_id <> q.product_id
                LEFT JOIN (SELECT a.product_id, b.product_id AS other, {ALL_SCORES[metric]} AS score
                    FROM (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM cells) a
                    JOIN (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM cells) b USING (feature)
                    WHERE a.product_id <> b.product_id GROUP BY 1, 2) s ON s.product_id = p.product_id AND s.other = q.product_id))
        WHERE rn <= 5""", "holdings", extra=(CELLS,))

    @query(oracle, f"neighbors_of_all_{metric}")
    def run(d: Domain) -> DataFrame:
        return rounded(neighbours.neighbors_of_all(all_cells(d), metric, 5), "score")


for _metric in similarity.METRICS:
    _neighbors_of_all(_metric)


# Drift between two report years: centroids per nation on the older year's holdings.
def yearly_cells(d: Domain, year: int) -> DataFrame:
    lines = d.raw("lineitem").filter(F.year("l_shipdate") == year)
    per_part = lines.groupBy("l_suppkey", "l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("raw_weight")
    )
    return per_part.select(
        F.col("l_suppkey").alias("product_id"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("feature"),
        (F.col("raw_weight").cast("double") / 1e6).alias("weight"),
    )


def year_sql(name: str, year: int) -> tuple[str, str]:
    return name, f"""SELECT l_suppkey AS product_id, 'p' || CAST(l_partkey AS VARCHAR) AS feature,
        CAST(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS DOUBLE) / 1e6 AS weight
        FROM lineitem WHERE year(l_shipdate) = {year} GROUP BY 1, 2"""


REGIONS = """SELECT s_suppkey AS product_id, n_regionkey AS cluster_id FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _regions(d: Domain) -> DataFrame:
    s, n = d.raw("supplier"), d.raw("nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("product_id"), F.col("n_regionkey").alias("cluster_id")
    )


@query(sql("""
    SELECT f.feature, CAST(c.cluster_id AS INTEGER) AS cluster_id, round(coalesce(o.value, 0), 9) AS value
    FROM (SELECT DISTINCT feature FROM new_year) f, (SELECT unnest(range(5)) AS cluster_id) c
    LEFT JOIN (SELECT cluster_id, feature, sum(weight) / (SELECT count(*) FROM regions r2 WHERE r2.cluster_id = r.cluster_id)
                   AS value FROM old_year JOIN regions r USING (product_id) GROUP BY 1, 2) o
        ON o.feature = f.feature AND o.cluster_id = c.cluster_id""",
    extra=(("regions", REGIONS), year_sql("old_year", 1996), year_sql("new_year", 2001))))
def centroid_alignment(d: Domain) -> DataFrame:
    means = clustering.label_means(yearly_cells(d, 1996), _regions(d))
    aligned = baseline.align_centroids(clustering.wide_centroids(means, 5), yearly_cells(d, 2001))
    return rounded(clustering.long_centroids(aligned, 5), "value", digits=9)


def silhouette_sql(name: str, cells: str) -> tuple[str, str]:
    """Mean silhouette of the region labels over one year's cells, from all pairs."""
    return name, f"""SELECT avg(CASE WHEN greatest(a, b) <> 0 THEN (b - a) / greatest(a, b) END) AS silhouette FROM (
        SELECT i, coalesce(max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END), 0) AS a,
            min(CASE WHEN own <> other THEN s / n END) AS b
        FROM (SELECT x.i, x.cluster_id AS own, y.cluster_id AS other, count(*) AS n,
                  sum(sqrt(greatest(x.n2 + y.n2 - 2 * coalesce(p.dot, 0), 0))) AS s
              FROM {cells}_norms x, {cells}_norms y LEFT JOIN {cells}_dots p ON p.i = x.i AND p.j = y.i GROUP BY 1, 2, 3)
        GROUP BY 1)"""


def norms_sql(cells: str) -> tuple[str, str]:
    return f"{cells}_norms", f"""SELECT product_id AS i, any_value(cluster_id) AS cluster_id, sum(weight * weight) AS n2
        FROM {cells} JOIN regions USING (product_id) GROUP BY 1"""


def dots_sql(cells: str) -> tuple[str, str]:
    return f"{cells}_dots", f"""SELECT x.product_id AS i, y.product_id AS j, sum(x.weight * y.weight) AS dot
        FROM {cells} x JOIN {cells} y USING (feature) GROUP BY 1, 2"""


@query(sql("""
    SELECT 'feature_jaccard' AS "check", round(j, 6) AS value, 0.8 AS threshold, j < 0.8 AS violated FROM v
    UNION ALL SELECT 'n_products_change_ratio', round(abs(n - bn) / greatest(bn, 1), 6), 0.2,
        abs(n - bn) / greatest(bn, 1) > 0.2 FROM v
    UNION ALL SELECT 'silhouette_min', round(s, 6), 0.05, s < 0.05 FROM v
    UNION ALL SELECT 'silhouette_drop_ratio', round((bs - s) / greatest(abs(bs), 1e-9), 6), 0.25,
        (bs - s) / greatest(abs(bs), 1e-9) > 0.25 FROM v
    UNION ALL SELECT 'inertia_change_ratio', round(abs(i - bi) / bi, 6), 0.5, abs(i - bi) / bi > 0.5 FROM v
    UNION ALL SELECT 'baseline_complete', 1.0, 1.0, FALSE FROM v""",
    extra=(("regions", REGIONS), year_sql("old_year", 1996), year_sql("new_year", 2001),
           norms_sql("old_year"), dots_sql("old_year"), silhouette_sql("old_silhouette", "old_year"),
           norms_sql("new_year"), dots_sql("new_year"), silhouette_sql("new_silhouette", "new_year"), ("v", """
    SELECT (SELECT count(*) FROM (SELECT feature FROM old_year INTERSECT SELECT feature FROM new_year)) /
            (SELECT count(*) FROM (SELECT feature FROM old_year UNION SELECT feature FROM new_year)) AS j,
        (SELECT count(DISTINCT product_id) FROM new_year) AS n, (SELECT count(DISTINCT product_id) FROM old_year) AS bn,
        (SELECT silhouette FROM new_silhouette) AS s, (SELECT silhouette FROM old_silhouette) AS bs,
        (SELECT sum(weight) FROM new_year) AS i, (SELECT sum(weight) FROM old_year) AS bi"""))))
def drift_checks(d: Domain) -> DataFrame:
    """Checks between two years, with the regions as clusters; the total weight stands in for the inertia."""
    old, new = yearly_cells(d, 1996), yearly_cells(d, 2001)
    numbers = new.agg(F.countDistinct("product_id").alias("n_products"), F.sum("weight").alias("inertia"))
    base = old.agg(F.countDistinct("product_id").alias("n"), F.sum("weight").alias("w"))

    def silhouette(cells: DataFrame) -> float | None:
        return selection.silhouette(cells, _regions(d).join(cells.select("product_id").distinct(), "product_id"))

    numbers = numbers.withColumns(
        {
            "feature_jaccard": baseline.feature_jaccard(old, new).scalar(),
            "silhouette": F.lit(silhouette(new)).cast("double"),
            "base_silhouette": F.lit(silhouette(old)).cast("double"),
            "base_n_products": base.select("n").scalar(),
            "base_inertia": base.select("w").scalar(),
        }
    )
    return rounded(baseline.drift_checks(numbers), "value")


# Profiles of the region clusters over all holdings.
CENTROIDS = ("centroids", """
    SELECT cluster_id, feature, sum(weight) / max(n) AS value FROM cells JOIN members USING (product_id)
    JOIN (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) USING (cluster_id) GROUP BY 1, 2""")


def centroids(d: Domain) -> DataFrame:
    return clustering.label_means(all_cells(d), _regions(d))


@query(sql("""SELECT cluster_id, feature, rank, round(value, 6) AS value FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster_id ORDER BY value DESC, feature) AS rank FROM centroids) WHERE rank <= 10 AND value > 0""",
           "holdings", extra=(("members", REGIONS), CELLS, CENTROIDS)))
def cluster_top_holdings(d: Domain) -> DataFrame:
    return rounded(profiling.top_features(centroids(d), 10), "value")


CLUSTER_INDUSTRIES = ("cluster_industries", f"""
    SELECT cluster_id, feature, value, row_number() OVER (PARTITION BY cluster_id ORDER BY value DESC, feature) AS rank
    FROM (SELECT c.cluster_id, coalesce(i.industry_name, '未知行业') AS feature, sum(c.value) AS value
          FROM (SELECT *, {BASE_MARKET.replace("code", "feature")} AS market FROM centroids) c
          LEFT JOIN industries i ON i.asset_code = c.feature AND i.market = c.market GROUP BY 1, 2)""")


@query(sql("""SELECT cluster_id, feature, rank, round(value, 6) AS value FROM cluster_industries WHERE rank <= 5""",
           "holdings", "securities", extra=(("members", REGIONS), CELLS, CENTROIDS, INDUSTRIES, CLUSTER_INDUSTRIES)))
def cluster_top_industries(d: Domain) -> DataFrame:
    industries = holdings.security_industries(d.securities())
    return rounded(profiling.industries_of_assets(centroids(d), industries), "value")


@query(sql("""SELECT cluster_id, institution_code, count(*) AS products FROM members JOIN products USING (product_id)
    GROUP BY 1, 2""", "products", extra=(("members", REGIONS),)))
def institution_distribution(d: Domain) -> DataFrame:
    return profiling.institution_counts(_regions(d), d.products())


@query(sql("""SELECT cluster_id, round((sum(m.n) - count(*)) / count(*), 6) AS ac_share_dominance_ratio
    FROM members JOIN (SELECT kept_id AS product_id, count(*) AS n FROM merge_map GROUP BY 1) m USING (product_id)
    GROUP BY 1""", "holdings", "products", extra=(("members", REGIONS), CROSS, FAMILY, MERGE)))
def share_merge_ratio(d: Domain) -> DataFrame:
    merge_map = cut_lineage(holdings.share_class_map(cross_rows(d)))
    kept = _regions(d).join(merge_map.select(F.col("kept_id").alias("product_id")).distinct(), "product_id", "left_semi")
    return rounded(profiling.share_merge_ratio(kept, merge_map), "ac_share_dominance_ratio")


# A product's own assets that the cluster mean shares count once, all others add their square.
DISTANCES = ("distances", """
    SELECT m.product_id, m.cluster_id, sqrt(greatest(xx.s + cc.s - 2 * coalesce(dot.s, 0), 0)) AS x
    FROM members m JOIN (SELECT product_id, sum(weight * weight) AS s FROM cells GROUP BY 1) xx USING (product_id)
    JOIN (SELECT cluster_id, sum(value * value) AS s FROM centroids GROUP BY 1) cc USING (cluster_id)
    LEFT JOIN (SELECT m.product_id, sum(c.weight * t.value) AS s FROM cells c JOIN members m USING (product_id)
               JOIN centroids t ON t.cluster_id = m.cluster_id AND t.feature = c.feature GROUP BY 1) dot
        USING (product_id)""")


def _profile_inputs(d: Domain, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The given cells and labels, materialised means and distances."""
    labels = _regions(d)
    k = labels.agg(F.max("cluster_id")).first()[0] + 1
    means = materialise(clustering.label_means(cells, labels), "means")
    wide = clustering.wide_centroids(means, k)
    return cells, labels, means, materialise(clustering.member_distances(cells, labels, wide, k), "distances")


@query(sql("""SELECT cluster_id, product_id, rank, round(x, 6) AS distance_to_center FROM (SELECT *, row_number() OVER (
        PARTITION BY cluster_id ORDER BY round(x, 9), product_id) AS rank FROM distances) WHERE rank <= 5""",
           "holdings", extra=(("members", REGIONS), CELLS, CENTROIDS, DISTANCES)))
def cluster_representatives(d: Domain) -> DataFrame:
    cells, _, means, placed = _profile_inputs(d, materialise(all_cells(d), "cells"))
    discard(cells, means)
    return rounded(profiling.representatives(placed), "distance_to_center")


LABEL = r"""(SELECT string_agg(s, ' + ' ORDER BY r) FROM (SELECT s, min(rank) AS r, row_number() OVER (ORDER BY min(rank)) AS p
    FROM (SELECT rank, regexp_replace(feature, '\s*(Ⅱ|III|II|I|1|2|3)$', '') AS s FROM cluster_industries i
          WHERE i.cluster_id = m.cluster_id AND rank <= 5 AND value >= 0.05 AND feature <> '未知行业') GROUP BY s)
    WHERE p <= 3)"""


# Weights in texts are whole millionths, which both engines write alike.
MILLIONTHS = "CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR)"


def _overlap_sql(weight: str) -> str:
    return f"""(SELECT cluster_id, sum(least(a.{weight}, b.{weight})) AS s
        FROM (SELECT c.*, m.cluster_id FROM cells c JOIN members m USING (product_id)) a
        JOIN (SELECT c.*, m.cluster_id FROM cells c JOIN members m USING (product_id)) b
            USING (cluster_id, feature) WHERE a.product_id < b.product_id GROUP BY 1)"""


@query(sql(f"""
    SELECT m.cluster_id, count(*) AS size, {LABEL} AS cluster_label, round(max(v.hhi), 6) AS avg_hhi,
        coalesce({LABEL}, '簇 #' || CAST(m.cluster_id AS VARCHAR)) AS display_label,
        round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(max(p.s), 0) / (count(*) * (count(*) - 1) / 2) END, 6)
            AS avg_overlap_raw,
        round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(max(q.s), 0) / (count(*) * (count(*) - 1) / 2) END, 6)
            AS avg_overlap,
        (SELECT string_agg(feature || ':' || {MILLIONTHS}, ',' ORDER BY rank) FROM (SELECT feature, value, row_number() OVER (
            ORDER BY value DESC, feature) AS rank FROM centroids c WHERE c.cluster_id = m.cluster_id)
            WHERE rank <= 10 AND value > 0) AS top_holdings,
        (SELECT string_agg(feature || ':' || {MILLIONTHS}, ',' ORDER BY rank) FROM cluster_industries i
            WHERE i.cluster_id = m.cluster_id AND rank <= 5) AS top_industries,
        (SELECT string_agg(institution_code || ':' || CAST(n AS VARCHAR), ',' ORDER BY institution_code) FROM (
            SELECT institution_code, count(*) AS n FROM members x JOIN products USING (product_id)
            WHERE x.cluster_id = m.cluster_id GROUP BY 1)) AS institutions,
        round((sum(coalesce(g.n, 1)) - count(*)) / count(*), 6) AS ac_share_dominance_ratio,
        (SELECT string_agg(CAST(product_id AS VARCHAR) || ' ' || product_code || ' ' || product_name, ',' ORDER BY rank)
            FROM (SELECT product_id, row_number() OVER (ORDER BY round(x, 9), product_id) AS rank
                FROM distances t WHERE t.cluster_id = m.cluster_id) JOIN products USING (product_id) WHERE rank <= 5)
            AS representatives
    FROM members m LEFT JOIN (
        SELECT cluster_id, avg(hhi) AS hhi FROM (SELECT product_id, sum(raw_weight * raw_weight) AS hhi FROM cells
        GROUP BY 1) JOIN members USING (product_id) GROUP BY 1) v USING (cluster_id)
    LEFT JOIN {_overlap_sql("raw_weight")} p USING (cluster_id) LEFT JOIN {_overlap_sql("weight")} q USING (cluster_id)
    LEFT JOIN (SELECT kept_id AS product_id, count(*) AS n FROM merge_map GROUP BY 1) g USING (product_id)
    GROUP BY m.cluster_id""", "holdings", "products", "securities",
    extra=(("members", REGIONS), CELLS, CENTROIDS, DISTANCES, INDUSTRIES, CLUSTER_INDUSTRIES, CROSS, FAMILY, MERGE)))
def cluster_profiles(d: Domain) -> DataFrame:
    """Every part of the profiles, with the products that were folded into the members."""
    # The holdings are derived and written once, with the columns that the merge map and the cells need.
    held = materialise(d.holdings().select("product_id", "report_date", "asset_code", "asset_type", "weight"), "holdings")
    cross = holdings.cross_section(d.products(), held, d.report_date(), TYPES)
    merge_map = cut_lineage(holdings.share_class_map(cross))
    cells = materialise(cells_of(dealt_by_product(d, held)), "cells")
    discard(held)
    cells, labels, means, placed = _profile_inputs(d, cells)
    industries = holdings.security_industries(d.securities())
    rows = profiling.build_profiles(cells, labels, means, placed, d.products(), merge_map, industries)
    shown = display_label(F.lit(None).cast("string"), F.col("cluster_label"), F.col("cluster_id"))

    def weighed(column: str, name: str):
        whole = lambda x: F.concat(x[name], F.lit(":"), F.round(x["weight"] * 1000000).cast("bigint").cast("string"))
        return F.array_join(F.transform(column, whole), ",").alias(column)

    counts = F.transform(F.map_entries("institution_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    named = F.zip_with(
        F.arrays_zip("representative_products", "representative_codes"),
        "representative_names",
        lambda p, n: F.concat_ws(" ", p["representative_products"].cast("string"), p["representative_codes"], n),
    )
    # One row per cluster is all that stays.
    profiles = materialise(
        rows.select(
            "cluster_id",
            "size",
            "cluster_label",
            shown.alias("display_label"),
            "avg_hhi",
            "avg_overlap",
            "avg_overlap_raw",
            "ac_share_dominance_ratio",
            weighed("top_holdings", "asset_code"),
            weighed("top_industries", "industry"),
            F.array_join(counts, ",").alias("institutions"),
            F.array_join(named, ",").alias("representatives"),
        ),
        "profiles",
    )
    discard(cells, means, placed)
    return rounded(profiles, "avg_hhi", "avg_overlap", "avg_overlap_raw", "ac_share_dominance_ratio")


@query(sql("""
    WITH top AS (SELECT * FROM cluster_industries WHERE rank <= 5),
    peak AS (SELECT feature, max(value) AS peak FROM top GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
    SELECT feature AS industry, round(peak, 6) AS peak, """ + ", ".join(
    f"""(SELECT round(max(value), 6) FROM top t WHERE t.feature = p.feature AND t.cluster_id = {i}) AS "{i}" """
    for i in range(5)) + """ FROM peak p""", "holdings", "securities",
    extra=(("members", REGIONS), CELLS, CENTROIDS, INDUSTRIES, CLUSTER_INDUSTRIES)).replace(")\nWITH top AS", "),\ntop AS"))
def industry_cluster_matrix(d: Domain) -> DataFrame:
    industries = holdings.security_industries(d.securities())
    top = cut_lineage(profiling.industries_of_assets(centroids(d), industries))
    rows = top.select("cluster_id", F.col("feature").alias("industry"), F.col("value").alias("weight"))
    ids = list(range(5))
    return rounded(profiling.industry_matrix(rows, ids), "peak", *[str(i) for i in ids])
