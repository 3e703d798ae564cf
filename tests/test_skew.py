"""Hot keys: split joins and rankings must equal the plain forms."""

from __future__ import annotations

import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdscope.catalogue import QUERIES
from holdscope.catalogue.domain import Domain
from holdscope.operators import similarity, skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{i % 40}"
        value = None if i % 50 == 0 else round(rng.choice([rng.random(), 0.5]), 6)
        data.append((key, i, value))
    return spark.createDataFrame(data, "k STRING, id LONG, v DOUBLE")


def brute_rank(pdf, descending):
    pdf = pdf.copy()
    pdf["null"] = pdf.v.isna()
    pdf["order"] = -pdf.v if descending else pdf.v
    pdf = pdf.sort_values(["k", "null", "order", "id"])
    pdf["want"] = pdf.groupby("k").cumcount() + 1
    return pdf.set_index("id")["want"]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_ranked_is_exact(rows, descending, ranges):
    got = skew.ranked(rows, ["k"], "v", ["id"], descending=descending, ranges=ranges).toPandas()
    want = brute_rank(rows.toPandas(), descending)
    assert len(got) == 900
    assert (got.set_index("id")["rank"].sort_index() == want.sort_index()).all()


def test_equal_values_and_keys_without_a_name_split(spark, monkeypatch):
    """One key of equal values, and NULL keys and values, are cut into ranges of about equal size."""
    data = spark.range(20_000, numPartitions=8).select(
        F.when(F.col("id") % 4 != 0, "hot").alias("k"), "id", F.when(F.col("id") % 5 != 0, F.lit(0.0)).alias("v")
    )
    sizes = []
    real = skew.cut_lineage

    def watched(df):
        done = real(df)
        if "_range" in done.columns:
            sizes.extend(r["count"] for r in done.groupBy("_range").count().collect())
        return done

    monkeypatch.setattr(skew, "cut_lineage", watched)
    got = skew.ranked(data, ["k"], "v", ["id"], ranges=20).toPandas()
    assert len(sizes) == 20 and max(sizes) < 2_500
    for _, group in got.groupby("k", dropna=False):
        by = group.assign(null=group.v.isna()).sort_values(["null", "id"])
        assert by["rank"].tolist() == list(range(1, len(by) + 1))


@pytest.mark.parametrize("ranges", [1, 30])
def test_exact_median(rows, ranges):
    got = skew.exact_median(rows, ["k"], "v", ranges).toPandas().set_index("k")["median"]
    want = rows.toPandas().dropna().groupby("k")["v"].median()
    assert (got.sort_index() - want.sort_index()).abs().max() < 1e-12


def test_attach_keeps_every_row(spark, rows):
    per_key = spark.createDataFrame([("hot", 1.0), ("k0", 2.0)], "k STRING, x DOUBLE")
    left = skew.attach(rows, per_key, ["k"])
    assert left.count() == 900
    assert left.filter("k = 'hot' AND x = 1.0").count() == rows.filter("k = 'hot'").count()
    assert skew.attach(rows, per_key, ["k"], "inner").filter("k NOT IN ('hot', 'k0')").count() == 0


def test_top_rows_prunes_before_the_shuffle(rows):
    top = skew.top_rows(rows, ["k"], [F.col("v").desc(), F.col("id")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("ranges", [1, 25])
def test_mean_pairwise_overlap_with_a_hot_feature(spark, monkeypatch, ranges):
    real = skew.ranked
    monkeypatch.setattr(similarity, "ranked", lambda *a, **k: real(*a, **{**k, "ranges": ranges}))
    rng = random.Random(5)
    cells = [(p, "all", round(rng.random(), 2)) for p in range(40)]
    cells += [(p, f"f{rng.randrange(6)}x{j}", rng.random()) for p in range(40) for j in range(2)]
    frame = pd.DataFrame(cells, columns=["product_id", "feature", "raw_weight"]).drop_duplicates(["product_id", "feature"])
    labels = [(p, p % 2) for p in range(40)]
    got = similarity.mean_pairwise_overlap(
        spark.createDataFrame(frame), spark.createDataFrame(labels, "product_id LONG, cluster_id INT")
    ).toPandas().set_index("cluster_id")["avg_overlap"]
    wide = frame.pivot(index="product_id", columns="feature", values="raw_weight").fillna(0.0)
    for c in (0, 1):
        own = wide[wide.index % 2 == c].to_numpy()
        n = len(own)
        total = sum(min(a, b) for i in range(n) for j in range(i) for a, b in zip(own[i], own[j]))
        assert got[c] == pytest.approx(total / (n * (n - 1) / 2))


@pytest.mark.parametrize("hot", [0, 30, 10**6])
def test_overlaps_of_hot_and_other_features(spark, monkeypatch, hot):
    """Several weights, with ties and zeros: features ranked whole, in ranges, or some one way and some the other."""
    monkeypatch.setattr(similarity, "HOT_ROWS", hot)
    rng = random.Random(9)
    rows = [(p, f, rng.randrange(5) / 4, rng.random()) for p in range(90) for f in ["all", *rng.sample("abcdefgh", 3)]]
    labels = [(p, p % 3) for p in range(92)]
    cells = spark.createDataFrame(rows, "product_id LONG, feature STRING, a DOUBLE, b DOUBLE")
    got = similarity.mean_pairwise_overlaps(
        cells, spark.createDataFrame(labels, "product_id LONG, cluster_id INT"), {"a": "mean_a", "b": "mean_b"}
    ).toPandas().set_index("cluster_id")
    for column, name in ((2, "mean_a"), (3, "mean_b")):
        for c in range(3):
            own = {p: {r[1]: r[column] for r in rows if r[0] == p} for p, k in labels if k == c}
            sums = [sum(min(w, own[q].get(f, 0.0)) for f, w in own[p].items()) for p in own for q in own if p < q]
            assert got[name][c] == pytest.approx(sum(sums) / len(sums))


def test_profiles_leave_only_what_is_small(spark):
    """The holdings, the cells and the steps on them leave the shared folder with the query."""
    skew.cut_lineage(spark.range(1))  # names the shared folder
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {x.name for x in folder.iterdir()}
    rows = QUERIES["cluster_profiles"](spark, "/root/testdata/sf0.001").collect()
    assert rows
    left = {x.name.rsplit("-", 1)[0] for x in folder.iterdir() if x.name not in before and any(x.glob("*.parquet"))}
    assert left <= {"families", "totals", "profiles"}


def partitions(df) -> list[int]:
    """Rows of each task that ends with this frame."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_tasks_grow_with_the_holdings(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 200)
    d = Domain(spark, "/root/testdata/sf0.001")
    tasks = -(-d.raw("lineitem").count() // 200)
    assert d.held().rdd.getNumPartitions() == tasks
    assert d.holdings().rdd.getNumPartitions() == tasks


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """Keys that fill several ranges, nulls among them, and keys that share one."""
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    rows = [(k, i * 7 % 31 if i % 5 else None, i) for k, n in ((None, 400), (1, 3), (2, 700), (3, 1), (4, 96)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = skew.ranked(df, ["k"], "v", ["i"])
    assert max(partitions(got)) < 400
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), "i")))
    assert {(r.k, r.i): r["rank"] for r in got.collect()} == {(r.k, r.i): r.want for r in want.collect()}
    assert got.count() == len(rows)
