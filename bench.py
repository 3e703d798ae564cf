"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated list (``all`` runs the whole catalogue).
"""

from __future__ import annotations

import json
import os
import re
import time

from holdscope.catalogue import QUERIES
from holdscope.session import local_session

HEADLINE = (
    "latest_snapshot_per_product",
    "coverage_by_institution",
    "holdings_search_page",
    "dashboard_totals",
    "nav_history",
    "asof_window_return",
    "member_value_snapshot",
    "composite_index_rebased",
    "value_dispersion",
    "industry_daily_returns",
    "industry_correlation",
    "holdings_cross_section",
    "weight_features_asset",
    "weight_features_industry",
    "neighbors_overlap",
    "mean_pairwise_overlap",
    "brinson_by_cluster",
    "kmeans_assign",
    "silhouette_by_label",
    "cluster_profiles",
    "append_new_rows",
    "upsert_rows",
    "parse_kline_lines",
    "parse_report_html",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query loads classes and warms the compiler.
    QUERIES["latest_count_by_institution"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )


if __name__ == "__main__":
    main()
