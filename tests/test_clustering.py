"""k-means, silhouette, choice of k, baselines: against dense brute force on small blobs."""

from __future__ import annotations

import numpy as np
import pytest

from holdscope.operators import baseline, clustering, kmeans_many, packed, selection, silhouette
from holdscope.operators.packed import Centres, Sparse, pack


def blobs(seed, centres, sd, each, extra=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, sd, size=(each, len(c))) for c in centres])
    return np.hstack([x, rng.normal(size=(len(x), extra)) * 0.01]) if extra else x


def frame(spark, x):
    rows = [(i, f"f{j}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "product_id LONG, feature STRING, weight DOUBLE")


def wide(spark, centres):
    rows = [(f"f{j}", *[float(c[j]) for c in centres]) for j in range(len(centres[0]))]
    names = ", ".join(f"c{i} DOUBLE" for i in range(len(centres)))
    return spark.createDataFrame(rows, f"feature STRING, {names}")


def lloyd(x, centres, max_iter, tol, keep):
    centres = centres.copy()
    for n in range(1, max_iter + 1):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
        labels = d.argmin(axis=1)
        inertia = d.min(axis=1).sum()
        new = centres.copy()
        for c in range(len(centres)):
            if (labels == c).any():
                new[c] = x[labels == c].mean(axis=0)
            elif not keep:
                new[c] = x[d.min(axis=1).argmax()]
        shift = np.linalg.norm(centres - new)
        centres = new
        if shift < tol:
            break
    return labels, centres, inertia, n


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(len(x)):
        same = labels == labels[i]
        a = d[i, same].sum() / (same.sum() - 1) if same.sum() > 1 else 0.0
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def labels_of(result):
    return np.array([r["cluster_id"] for r in result.labels.orderBy("product_id").collect()])


THREE = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]


@pytest.mark.parametrize("keep", [True, False])
def test_lloyd_equals_dense_form_with_an_empty_cluster(spark, keep):
    x = blobs(42, THREE, 0.5, 20)
    start = np.array([[1.0, 1.0], [9.0, 1.0], [1.0, 8.0], [500.0, 500.0]])
    points = clustering.prepare(frame(spark, x))
    got = clustering.lloyd(points, wide(spark, start), 4, keep_empty=keep)
    labels, centres, inertia, n = lloyd(x, start, 100, 1e-4, keep)
    points.unpersist()
    assert (labels_of(got) == labels).all()
    assert got.n_iter == n
    assert got.inertia == pytest.approx(inertia)
    cells = {(r["cluster_id"], r["feature"]): r["value"] for r in clustering.long_centroids(got.centroids, 4).collect()}
    for c in range(4):
        assert [cells[c, "f0"], cells[c, "f1"]] == pytest.approx(list(centres[c]))


def test_assign_without_broadcast(spark):
    x = blobs(1, THREE, 0.5, 10)
    centres = wide(spark, np.array(THREE))
    a = clustering.assign(frame(spark, x), centres, clustering.squared_norms(centres, 3), small=False)
    b = clustering.assign(frame(spark, x), centres, clustering.squared_norms(centres, 3), small=True)
    assert sorted(a.collect()) == sorted(b.collect())


def test_warm_start_from_converged_centres(spark):
    points = frame(spark, blobs(42, THREE, 0.5, 30))
    full = clustering.kmeans(points, 3)
    warm = clustering.kmeans_from(points, full.centroids, 3)
    assert warm.n_iter <= 2
    assert warm.inertia == pytest.approx(full.inertia, rel=1e-3)


def test_seeding_is_repeatable_and_spread(spark):
    points = frame(spark, blobs(42, THREE, 0.5, 30))
    one, two = (sorted(clustering.seed_plus_plus(points, 3, 42).collect()) for _ in range(2))
    assert one == two
    result = clustering.kmeans(points, 3)
    assert sorted(np.bincount(labels_of(result))) == [30, 30, 30]
    with pytest.raises(ValueError):
        clustering.kmeans(points, 0)
    with pytest.raises(ValueError):
        clustering.kmeans(points, 3, init="grid")


def test_identical_points_seed_without_error(spark):
    points = spark.createDataFrame([(i, "a", 1.0) for i in range(5)], "product_id LONG, feature STRING, weight DOUBLE")
    picked = clustering.seed_plus_plus(points, 3, 1)
    assert picked.columns == ["feature", "c0", "c1", "c2"]


@pytest.mark.parametrize("block_rows", [7, 512])
def test_silhouette_equals_brute_force(spark, block_rows):
    x = blobs(9, THREE, 3.0, 12, extra=2)
    labels = np.array([i % 3 for i in range(len(x))])
    other = np.array([0] + [1 + i % 2 for i in range(1, len(x))])
    tables = [
        spark.createDataFrame([(i, int(c)) for i, c in enumerate(l)], "product_id LONG, cluster_id INT")
        for l in (labels, other)
    ]
    got = {r["run"]: r["silhouette"] for r in selection.silhouettes(frame(spark, x), tables, block_rows).collect()}
    assert got[0] == pytest.approx(brute_silhouette(x, labels))
    # The single member of label 0 has a = 0 and scores 1.
    assert got[1] == pytest.approx(brute_silhouette(x, other))


@pytest.mark.parametrize("room", [True, False])
def test_silhouette_of_sparse_vectors_copies_few_blocks(spark, monkeypatch, room):
    """Vectors of some of many features: no dense products, and a product goes to few tasks."""
    rng = np.random.default_rng(4)
    x = np.zeros((300, 900))
    for row in x:
        row[rng.choice(900, 6, replace=False)] = rng.random(6) + 0.1
    labels = rng.integers(0, 3, len(x))
    table = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "product_id LONG, cluster_id INT")
    if not room:
        monkeypatch.setattr(selection, "pack", lambda points, centres: None)
    got = selection.silhouette(frame(spark, x), table)
    assert got == pytest.approx(brute_silhouette(x, labels))
    # Within the bound on cells the number of blocks does not grow with the rows.
    assert silhouette.rows_of(50_000, 50_000 * 64, 75) > 40_000
    assert silhouette.rows_of(10, 10, 10_000_000) >= 1
    monkeypatch.setattr(silhouette, "BLOCK_CELLS", 100)
    monkeypatch.setattr(silhouette, "STRIP", 50)
    assert selection.silhouette(frame(spark, x), table) == pytest.approx(got)


def test_silhouette_is_undefined_for_one_label(spark):
    x = blobs(9, THREE, 1.0, 3)
    one = spark.createDataFrame([(i, 0) for i in range(9)], "product_id LONG, cluster_id INT")
    each = spark.createDataFrame([(i, i) for i in range(9)], "product_id LONG, cluster_id INT")
    assert selection.silhouette(frame(spark, x), one) is None
    assert selection.silhouette(frame(spark, x), each) is None


def test_select_k(spark):
    x = blobs(7, [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0), (5.0, 5.0)], 0.4, 15)
    best, result, table, rule = selection.select_k(frame(spark, x), 2, 4, max_iter=10)
    assert 2 <= best <= 4
    assert table.count() == 3
    assert rule == "silhouette_elbow_composite"
    assert result.k == best
    best, _, _, rule = selection.select_k(frame(spark, x), 3, 3, max_iter=5)
    assert (best, rule) == (3, "silhouette_only")


def test_composite_scores_formula(spark):
    data = [(2, 100.0, 0.2, 3), (3, 30.0, 0.6, 3), (4, 25.0, 0.5, 3), (5, 24.0, 0.5, 3)]
    table = spark.createDataFrame(data, "k INT, inertia DOUBLE, silhouette DOUBLE, n_iter INT")
    log = np.log([d[1] for d in data])
    curve = np.array([0.0, 2 * log[1] - log[0] - log[2], 2 * log[2] - log[1] - log[3], 0.0])
    sil = np.array([d[2] for d in data])
    norm = lambda v: (v - v.min()) / (v.max() - v.min())
    got = [r["composite"] for r in selection.composite_scores(table).orderBy("k").collect()]
    assert got == pytest.approx(list(norm(sil) + 0.3 * norm(curve)))
    flat = selection.composite_scores(table.withColumn("silhouette", table["silhouette"] * 0)).first()
    assert flat["silhouette_norm"] == 0.5


def test_align_centroids(spark):
    old = spark.createDataFrame([("a", 1.0, 4.0), ("b", 2.0, 5.0), ("c", 3.0, 6.0)], "feature STRING, c0 DOUBLE, c1 DOUBLE")
    new = spark.createDataFrame([("b",), ("c",), ("d",)], "feature STRING")
    got = {r["feature"]: (r["c0"], r["c1"]) for r in baseline.align_centroids(old, new).collect()}
    assert got == {"b": (2.0, 5.0), "c": (3.0, 6.0), "d": (0.0, 0.0)}


def numbers(spark, **change):
    row = dict(feature_jaccard=1.0, n_products=60, silhouette=0.8, inertia=10.0,
               base_n_products=60, base_silhouette=0.8, base_inertia=10.0)
    row.update(change)
    return spark.createDataFrame(
        [tuple(row.values())],
        "feature_jaccard DOUBLE, n_products LONG, silhouette DOUBLE, inertia DOUBLE, "
        "base_n_products LONG, base_silhouette DOUBLE, base_inertia DOUBLE",
    )


def test_drift_checks(spark):
    def violated(limits=baseline.DriftLimits(), **change):
        rows = baseline.drift_checks(numbers(spark, **change), limits).collect()
        return {r["check"] for r in rows if r["violated"]}

    assert violated() == set()
    assert violated(limits=baseline.DriftLimits(silhouette_min=0.999)) == {"silhouette_min"}
    assert violated(feature_jaccard=0.79) == {"feature_jaccard"}
    assert violated(n_products=80) == {"n_products_change_ratio"}
    assert violated(silhouette=0.5) == {"silhouette_drop_ratio"}
    assert violated(silhouette=None) == {"silhouette_min", "silhouette_drop_ratio"}
    assert violated(inertia=16.0) == {"inertia_change_ratio"}
    # A baseline without a usable silhouette skips the drop check but is incomplete.
    assert violated(base_silhouette=None) == {"baseline_complete"}
    assert violated(base_silhouette=0.0) == set()


def test_feature_jaccard_of_empty_sets(spark):
    none = spark.createDataFrame([], "feature STRING")
    some = spark.createDataFrame([("a",)], "feature STRING")
    assert baseline.feature_jaccard(none, none).first()[0] == 1.0
    assert baseline.feature_jaccard(none, some).first()[0] == 0.0


@pytest.mark.parametrize("init", ["k-means++", "random"])
def test_runs_take_one_pass_an_iteration(spark, monkeypatch, init):
    x = blobs(11, [*THREE, (4.0, 4.0)], 1.5, 20, extra=3)
    points = frame(spark, x)
    monkeypatch.setattr(packed, "pack", lambda points, centres: None)
    want = clustering.kmeans(points, 4, 7, init=init)
    monkeypatch.undo()
    # The loop of one job per step is not needed here.
    monkeypatch.setattr(clustering, "lloyd", None)
    got = clustering.kmeans(points, 4, 7, init=init)
    assert (labels_of(got) == labels_of(want)).all()
    assert (got.n_iter, got.inertia) == (want.n_iter, pytest.approx(want.inertia))


def test_warm_start_with_an_empty_cluster_and_a_vanished_feature(spark, monkeypatch):
    x = blobs(42, THREE, 0.5, 20)
    start = np.array([[1.0, 1.0, 0.0], [9.0, 1.0, 3.0], [1.0, 8.0, 0.0], [500.0, 500.0, 0.0]])
    points, centres = frame(spark, x), wide(spark, start)
    for max_iter in (1, 100):
        monkeypatch.setattr(packed, "pack", lambda points, centres: None)
        want = clustering.kmeans_from(points, centres, 4, max_iter)
        monkeypatch.undo()
        got = clustering.kmeans_from(points, centres, 4, max_iter)
        assert (labels_of(got) == labels_of(want)).all()
        assert (got.n_iter, got.inertia) == (want.n_iter, pytest.approx(want.inertia))
        cells = lambda r: {(c["cluster_id"], c["feature"]): c["value"] for c in clustering.long_centroids(r.centroids, 4).collect()}
        assert cells(got) == pytest.approx(cells(want))


def test_all_k_in_one_loop_equal_single_runs(spark):
    x = blobs(3, [*THREE, (10.0, 10.0), (5.0, 5.0)], 1.5, 15, extra=3)
    points = frame(spark, x)
    packed = pack(points, 20)
    many = kmeans_many.kmeans_many(packed, [2, 3, 5, 6], 42, 100, 1e-4)
    for k, got in many.items():
        one = clustering.kmeans(points, k)
        assert (labels_of(got) == labels_of(one)).all()
        assert (got.n_iter, got.inertia) == (one.n_iter, pytest.approx(one.inertia))
        cells = lambda r: {(c["cluster_id"], c["feature"]): c["value"] for c in clustering.long_centroids(r.centroids, k).collect()}
        assert cells(got) == pytest.approx(cells(one))
        assert got.labels.agg({"d2": "sum"}).first()[0] == pytest.approx(got.inertia)
    with pytest.raises(ValueError):
        kmeans_many.kmeans_many(packed, [2, len(x) + 1], 42, 100, 1e-4)


def test_an_emptied_cluster_in_the_loop(spark):
    # Ten equal products: all but one of the centres drawn lose all members.
    points = spark.createDataFrame([(i, "a", 1.0) for i in range(10)] + [(10, "b", 2.0)], "product_id LONG, feature STRING, weight DOUBLE")
    many = kmeans_many.kmeans_many(pack(points, 10), [2, 3, 4], 1, 20, 1e-4)
    for k, got in many.items():
        one = clustering.kmeans(points, k, 1, 20)
        assert (labels_of(got) == labels_of(one)).all()
        assert got.inertia == pytest.approx(one.inertia)


def test_triangle_inequality_rules_out_distances_only(spark):
    rng = np.random.default_rng(0)
    x = blobs(5, [*THREE, (10.0, 10.0)], 0.4, 50)
    rows = pack(frame(spark, x), 20).rows.toArrow()
    sparse = Sparse(rows)
    groups = [x[rng.choice(len(x), k, replace=False)] for k in (2, 3, 8, 5)]
    labels, d2, computed = Centres(np.concatenate(groups), np.cumsum([0, 2, 3, 8, 5]).tolist()).nearest(sparse)
    order = np.array(rows.column("product_id").to_pylist())
    for g, centres in enumerate(groups):
        full = ((x[order][:, None] - centres[None]) ** 2).sum(axis=2)
        assert (labels[:, g] == full.argmin(axis=1)).all()
        assert d2[:, g] == pytest.approx(full.min(axis=1), abs=1e-9)
    assert computed < 0.8 * len(x) * 18


def test_without_room_for_the_centres(spark, monkeypatch):
    x = blobs(7, THREE, 0.4, 8)
    points = frame(spark, x)
    table, runs = selection.search_k(points, [2, 3])
    monkeypatch.setattr(selection, "pack", lambda points, centres: None)
    other, others = selection.search_k(points, [2, 3])
    for a, b in zip(sorted(table.collect()), sorted(other.collect()), strict=True):
        assert list(a) == pytest.approx(list(b))


def test_far_clusters_are_not_visited(spark):
    x = blobs(2, [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (3.0, 0.0), (200.0, 200.0)], 0.3, 12)
    labels = spark.createDataFrame([(i, i // 12) for i in range(len(x))], "product_id LONG, cluster_id INT")
    assert selection.silhouette(frame(spark, x), labels) == pytest.approx(brute_silhouette(x, np.arange(60) // 12))
    assert selection.visited_share(frame(spark, x), labels) <= 0.44
