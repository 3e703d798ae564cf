"""The analysis run on stored tables: modes, replacement, attribution, repeatable writes."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_clustering import blobs, frame

from holdscope.operators import attribution, holdings
from holdscope.operators.baseline import DriftLimits
from holdscope.plans import analysis
from holdscope.schemas import DDL, schema_of
from holdscope.sources import store
from holdscope.sources.tables import conform, create_table, read_table, write_table
from holdscope.streaming import increments

DAY = date(2026, 6, 30)
NOW = datetime(2026, 7, 1)


@pytest.fixture()
def root(spark, tmp_path):
    for table in DDL:
        create_table(spark, str(tmp_path), table)
    return str(tmp_path)


def product_rows(spark, n):
    return spark.createDataFrame(
        [(i, f"P{i}", f"Fund {i}", "TST", "equity", DAY) for i in range(n)],
        "product_id LONG, product_code STRING, product_name STRING, institution_code STRING, product_type STRING, "
        "collect_date DATE",
    )


@pytest.fixture()
def features(spark):
    cells = frame(spark, np.abs(blobs(1, [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0)], 0.5, 20, extra=6)))
    cells = cells.withColumn("raw_weight", F.col("weight"))
    industries = spark.createDataFrame([], "asset_code STRING, market STRING, industry_name STRING")
    return cells, None, product_rows(spark, 60), industries


SETTINGS = analysis.Settings(k=3, max_iter=20, random_seed=1)


def test_modes(spark, root, features):
    with pytest.raises(ValueError):
        analysis.cluster(spark, root, DAY, SETTINGS, mode="incremental", now=NOW, features=features)
    with pytest.raises(ValueError):
        analysis.cluster(spark, root, DAY, SETTINGS, mode="sometimes", now=NOW, features=features)
    first = analysis.cluster(spark, root, DAY, SETTINGS, now=NOW, features=features)
    assert (first["mode"], first["k"], first["baseline_run_id"]) == ("full", 3, None)
    assert first["silhouette"] > 0.5

    second = analysis.cluster(spark, root, DAY, SETTINGS, now=datetime(2026, 7, 2), features=features)
    assert (second["mode"], second["k"]) == ("incremental", 3)
    assert second["baseline_run_id"] == first["cluster_run_id"]

    # The third run replaces the second, but not the baseline the second names.
    third = analysis.cluster(spark, root, DAY, SETTINGS, now=datetime(2026, 7, 3), features=features)
    ids = {r["id"] for r in read_table(spark, root, "similarity_cluster_run").collect()}
    assert ids == {first["cluster_run_id"], third["cluster_run_id"]}
    members = read_table(spark, root, "similarity_cluster_members").groupBy("cluster_run_id").count().collect()
    assert {r["cluster_run_id"]: r["count"] for r in members} == {i: 60 for i in ids}
    clusters = read_table(spark, root, "similarity_clusters")
    assert clusters.agg(F.sum("size")).first()[0] == 120
    assert read_table(spark, root, "similarity_cluster_baseline").count() == 1

    strict = analysis.Settings(**{**SETTINGS.__dict__, "limits": DriftLimits(silhouette_min=0.9999)})
    with pytest.raises(analysis.DriftError):
        analysis.cluster(spark, root, DAY, strict, mode="incremental", now=NOW, features=features, save=False)
    back = analysis.cluster(spark, root, DAY, strict, now=datetime(2026, 7, 4), features=features, save=False)
    assert (back["mode"], back["baseline_run_id"]) == ("full", None)


def fund_tables(spark, root):
    """Twelve products of two styles over eight stocks in three industries, with prices."""
    codes = ["600001", "600002", "000001", "000002", "300001", "300002", "830001", "00700"]
    markets = ["SH", "SH", "SZ", "SZ", "SZ", "SZ", "BJ", "HK"]
    stamp = {"created_at": F.lit(NOW).cast("timestamp_ntz")}
    products = product_rows(spark, 12).withColumnRenamed("product_id", "id").withColumns(
        {**stamp, "updated_at": stamp["created_at"], "institution_type": F.lit("fund_company"),
         "institution_name": F.lit("T"), "risk_level": F.lit("R3"), "risk_level_standard": F.lit("L3"),
         "currency": F.lit("CNY"), "manager": F.lit("T"), "status": F.lit("active"), "data_source": F.lit("t")}
    )
    write_table(products, root, "product_info")
    rng = np.random.default_rng(5)
    rows = []
    for p in range(12):
        for j, (c, m) in enumerate(zip(codes, markets)):
            if j == p % 4 + 4:
                continue
            heavy = (j < 4) == (p < 6)
            rows.append((p * 100 + j, p, p, DAY, c, f"S{j}", "stock", m, float(round(rng.random() * (0.2 if heavy else 0.02) + 0.01, 6))))
    held = spark.createDataFrame(
        rows, "id LONG, report_id LONG, product_id LONG, report_date DATE, asset_code STRING, asset_name STRING, "
        "asset_type STRING, market STRING, weight DOUBLE",
    )
    write_table(held.withColumns(stamp), root, "product_holding")
    # The last stock has no industry.
    securities = spark.createDataFrame(
        [(j, c, m, f"S{j}", f"I{j % 3}" if j < 7 else None) for j, (c, m) in enumerate(zip(codes, markets))],
        "id LONG, asset_code STRING, market STRING, asset_name STRING, industry_name STRING",
    )
    write_table(securities.withColumns({**stamp, "updated_at": stamp["created_at"]}), root, "holding_security_info")
    # Stock 6 has no quote near the end date.
    quotes = [
        (j * 10 + n, d, m + c, m + c, "domestic", "stock", 10.0 + j + n * (j % 3 - 0.5), "CNY", "t")
        for j, (c, m) in enumerate(zip(codes, markets))
        for n, d in enumerate([date(2026, 3, 30), date(2026, 6, 28)])
        if not (j == 6 and n == 1)
    ]
    q = spark.createDataFrame(
        quotes, "id LONG, quote_date DATE, symbol_code STRING, symbol_name STRING, market_region STRING, "
        "asset_class STRING, close_price DOUBLE, currency STRING, data_source STRING",
    )
    write_table(q.withColumns(stamp), root, "market_quote")


def brute_brinson(held, industry, ret, members, bench=None):
    """The full product x industry grid in pandas."""
    h = held[held.symbol.isin(ret)].copy()
    h["r"] = h.symbol.map(ret)
    h["ind"] = [industry.get((c, m), "未知行业") for c, m in zip(h.asset_code, h.market)]
    out = {}
    for cluster, pids in members.items():
        own = h[h.product_id.isin(pids)]
        pool = own if bench is None else bench
        b = pool.groupby("ind").apply(lambda g: (g.weight.sum(), (g.weight * g.r).sum() / g.weight.sum()), include_groups=False)
        total = sum(v[0] for v in b)
        for pid, g in own.groupby("product_id"):
            w = g.groupby("ind").weight.sum() / g.weight.sum()
            r = g.groupby("ind").apply(lambda x: (x.weight * x.r).sum() / x.weight.sum(), include_groups=False)
            eff = np.zeros(5)
            for ind, (bw, rb) in b.items():
                wb, wp = bw / total, w.get(ind, 0.0)
                rp = r[ind] if wp else rb
                eff += [wp * rp, wb * rb, (wp - wb) * rb, wb * (rp - rb), (wp - wb) * (rp - rb)]
            out[pid] = eff
    return out


def test_analyse_end_to_end(spark, root):
    fund_tables(spark, root)
    settings = analysis.Settings(k=2, max_iter=20)
    result = analysis.analyse(spark, root, date(2026, 3, 31), DAY, settings=settings, now=NOW)
    assert result["report_date"] == DAY
    assert result["mode"] == "full"
    assert result["n_products"] == 12
    assert result["attribution"].agg(F.sum("n_products")).first()[0] == 12

    stored = read_table(spark, root, "similarity_attribution").toPandas().set_index("product_id")
    effects = stored.allocation_effect + stored.selection_effect + stored.interaction_effect
    assert np.allclose(effects, stored.excess_return)

    held = read_table(spark, root, "product_holding").toPandas()
    held["symbol"] = held.market + held.asset_code
    held["weight"] = held.weight.astype(float)
    q = read_table(spark, root, "market_quote").toPandas()
    q["close_price"] = q.close_price.astype(float)
    by = q.pivot(index="symbol_code", columns="quote_date", values="close_price").dropna()
    ret = dict(by.iloc[:, 1] / by.iloc[:, 0] - 1.0)
    s = holdings.security_industries(read_table(spark, root, "holding_security_info")).toPandas()
    industry = {(c, m): i for c, m, i in zip(s.asset_code, s.market, s.industry_name)}
    members = read_table(spark, root, "similarity_cluster_members").toPandas().groupby("cluster_id").product_id.apply(list)
    want = brute_brinson(held, industry, ret, dict(members))
    columns = ["total_return", "benchmark_return", "allocation_effect", "selection_effect", "interaction_effect"]
    for pid, eff in want.items():
        assert stored.loc[pid, columns].astype(float).to_numpy() == pytest.approx(eff)
    for _, g in stored.groupby("cluster_id"):
        assert sorted(g.rank_in_cluster) == list(range(1, len(g) + 1))
        assert g.sort_values("rank_in_cluster").excess_return.is_monotonic_decreasing

    # Attributing again replaces the rows instead of adding to them.
    analysis.attribute_run(spark, root, DAY, date(2026, 3, 31), DAY, k=2, now=NOW)
    assert read_table(spark, root, "similarity_attribution").count() == 12
    with pytest.raises(ValueError):
        analysis.attribute_run(spark, root, DAY, date(2026, 3, 31), DAY, benchmark="index")

    # An index that lacks two of the industries: they drop out of every product.
    index = held[held.asset_code == "600001"].head(1)[["asset_code", "market", "weight"]]
    index["r"] = ret["SH600001"]
    index["ind"] = industry["600001", "SH"]
    got = attribution.brinson(
        read_table(spark, root, "similarity_cluster_members"),
        read_table(spark, root, "product_holding"),
        holdings.security_industries(read_table(spark, root, "holding_security_info")),
        spark.createDataFrame([(k, float(v)) for k, v in ret.items()], "symbol_code STRING, stock_return DOUBLE"),
        spark.createDataFrame(index[["asset_code", "market", "weight"]]),
    ).toPandas().set_index("product_id")
    for pid, eff in brute_brinson(held, industry, ret, dict(members), index).items():
        assert got.loc[pid, columns].astype(float).to_numpy() == pytest.approx(eff)


def quotes_batch(spark, days, price):
    rows = [(i, date(2026, 7, d), f"S{i}", f"S{i}", "domestic", "index", float(price), "CNY", "t", NOW) for d in days for i in range(3)]
    df = spark.createDataFrame(
        rows, "id LONG, quote_date DATE, symbol_code STRING, symbol_name STRING, market_region STRING, "
        "asset_class STRING, close_price DOUBLE, currency STRING, data_source STRING, created_at TIMESTAMP_NTZ",
    )
    return conform(df, "market_quote")


ORDER = ["created_at", "close_price"]


def test_append_twice_inserts_once(spark, root):
    assert store.append_new(root, "market_quote", quotes_batch(spark, [1, 2], 5), ORDER) == (6, 0)
    assert store.append_new(root, "market_quote", quotes_batch(spark, [2, 3], 7), ORDER) == (3, 3)
    assert store.append_new(root, "market_quote", quotes_batch(spark, [2, 3], 7), ORDER) == (0, 6)
    rows = read_table(spark, root, "market_quote")
    assert rows.count() == 9
    assert rows.filter("close_price = 7").count() == 3


def test_upsert_touches_only_its_dates(spark, root):
    store.append_new(root, "market_quote", quotes_batch(spark, [1, 2], 5), ORDER)
    later = quotes_batch(spark, [2, 3], 9).withColumn("id", F.lit(99).cast("long"))
    store.upsert(root, "market_quote", later, ORDER, keep=("id", "created_at"))
    rows = read_table(spark, root, "market_quote").orderBy("quote_date", "symbol_code").collect()
    assert [float(r["close_price"]) for r in rows] == [5.0] * 3 + [9.0] * 6
    # Updated rows keep their id, new rows bring their own.
    assert [r["id"] for r in rows] == [0, 1, 2, 0, 1, 2, 99, 99, 99]


def test_order_decides_within_a_batch(spark, root):
    """Of equal keys in one batch the first is appended and the last is upserted, whatever the partitioning."""
    batch = quotes_batch(spark, [1], 5).unionByName(quotes_batch(spark, [1], 8)).unionByName(quotes_batch(spark, [1], 6))
    store.append_new(root, "market_quote", batch.repartition(7), ["close_price"])
    prices = lambda: {float(r["close_price"]) for r in read_table(spark, root, "market_quote").collect()}
    assert prices() == {5.0}
    for _ in range(2):
        store.upsert(root, "market_quote", batch.repartition(5), ["close_price"])
        assert prices() == {8.0}


def test_a_batch_reads_its_own_dates(spark, root):
    """The batch's dates are literals of the scan's partition filter."""
    store.append_new(root, "market_quote", quotes_batch(spark, list(range(1, 20)), 5), ORDER)
    stored = store.touched(read_table(spark, root, "market_quote"), quotes_batch(spark, [3, 4], 7), "market_quote")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.split("PartitionFilters")[1:])[:200]
    assert "quote_date" in filters and "20638" in filters.replace(",", "") or "2026-07-03" in filters
    assert stored.count() == 6


def test_unpartitioned_table_is_overwritten_by_versions(spark, root):
    rows = lambda code: conform(
        spark.createDataFrame([(1, code, "SH", NOW, NOW)], "id LONG, asset_code STRING, market STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"),
        "holding_security_info",
    )
    store.upsert(root, "holding_security_info", rows("A"), ["id"])
    reader = read_table(spark, root, "holding_security_info")
    store.upsert(root, "holding_security_info", rows("B"), ["id"])
    assert {r["asset_code"] for r in read_table(spark, root, "holding_security_info").collect()} == {"A", "B"}
    # A reader of the version before goes on undisturbed.
    assert {r["asset_code"] for r in reader.collect()} == {"A"}
    # A version that was not completed is not seen.
    (__import__("pathlib").Path(root) / "holding_security_info" / "version=99").mkdir()
    assert read_table(spark, root, "holding_security_info").count() == 2


def test_run_saved_twice_and_superseded(spark, root, features):
    first = analysis.cluster(spark, root, DAY, SETTINGS, mode="full", now=NOW, features=features)
    cells = read_table(spark, root, "similarity_baseline_centroids").count()
    again = analysis.cluster(spark, root, DAY, SETTINGS, mode="full", now=NOW, features=features)
    assert again["cluster_run_id"] == first["cluster_run_id"]
    assert read_table(spark, root, "similarity_baseline_centroids").count() == cells
    assert read_table(spark, root, "similarity_cluster_members").count() == 60
    note = {"cluster_run_id": F.lit(first["cluster_run_id"]), "start_date": F.lit(DAY), "end_date": F.lit(DAY),
            "report_date": F.lit(DAY), "benchmark_type": F.lit("cluster_avg"), "created_at": F.lit(NOW).cast("timestamp_ntz"),
            "cluster_id": F.lit(0)}
    write_table(spark.range(1).select(F.col("id").alias("product_id")).withColumns(note), root, "similarity_attribution")
    # A later full run replaces the first: its centroids and its attribution go with it.
    later = analysis.cluster(spark, root, DAY, SETTINGS, mode="full", now=datetime(2026, 7, 9), features=features)
    left = read_table(spark, root, "similarity_baseline_centroids").select("cluster_run_id").distinct().collect()
    assert [r[0] for r in left] == [later["cluster_run_id"]]
    assert read_table(spark, root, "similarity_attribution").count() == 0


def test_streams_are_repeatable(spark, root, tmp_path):
    landed = str(tmp_path / "landed")
    quotes_batch(spark, [1], 5).write.mode("append").parquet(landed)

    def run(start, name):
        stream = spark.readStream.schema(schema_of("market_quote")).parquet(landed)
        start(stream, root, "market_quote", str(tmp_path / name)).awaitTermination(120)

    run(increments.append_stream, "one")
    quotes_batch(spark, [1, 2], 8).write.mode("append").parquet(landed)
    run(increments.append_stream, "one")
    rows = read_table(spark, root, "market_quote")
    assert rows.count() == 6
    assert rows.filter("close_price = 8").count() == 3
    run(increments.upsert_stream, "two")
    assert read_table(spark, root, "market_quote").count() == 6


def test_later_rows_of_a_file_win(spark, root, tmp_path):
    landed = str(tmp_path / "landed")
    batch = quotes_batch(spark, [1], 5).unionByName(quotes_batch(spark, [1], 9)).unionByName(quotes_batch(spark, [1], 7))
    batch.coalesce(1).write.parquet(landed)
    stream = spark.readStream.schema(schema_of("market_quote")).parquet(landed)
    increments.upsert_stream(stream, root, "market_quote", str(tmp_path / "c")).awaitTermination(120)
    assert {float(r["close_price"]) for r in read_table(spark, root, "market_quote").collect()} == {7.0}


def test_tables_keep_their_schema(spark, root):
    for table in DDL:
        got = {f.name: f.dataType for f in read_table(spark, root, table).schema.fields}
        assert got == {f.name: f.dataType for f in schema_of(table).fields}
