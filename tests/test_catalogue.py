"""Catalogue queries against their oracles, and the shape of their plans.

A choice from every area runs by default; ``CATALOGUE=all`` runs every query (some ten
minutes). ``python tests/oracle.py 0.01`` does the same on the larger data.
"""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

from bench import HEADLINE
from holdscope.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
MORE = (
    "product_search_page", "filter_menus", "fetch_work_list", "recent_failures", "last_rows_per_symbol",
    "market_breakdown", "share_class_map", "concentration_hhi", "industry_update_counts", "kmeans_warm_centroids",
    "distance_histogram", "drift_checks", "centroid_alignment", "cluster_representatives", "run_members",
    "run_comparison", "superseded_runs", "replace_rows", "close_stale_jobs", "product_feed_citic",
    "product_feed_funds", "index_weight_file", "summary_of_latest_quarter", "brinson_index_benchmark",
)
NAMES = list(QUERIES) if os.environ.get("CATALOGUE") == "all" else [*HEADLINE, *MORE]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        ok, message, _ = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        assert df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
