"""Declared schemas, natural keys and storage partitioning of the tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_WEIGHTS = "ARRAY<STRUCT<{name}: STRING, weight: DOUBLE>>"

DDL: dict[str, str] = {
    "product_info": """id BIGINT NOT NULL, institution_type STRING NOT NULL, institution_name STRING NOT NULL,
        institution_code STRING NOT NULL, product_code STRING NOT NULL, product_name STRING NOT NULL,
        product_short_name STRING, product_type STRING NOT NULL, product_sub_type STRING,
        registration_code STRING, sales_code STRING, establish_date DATE, maturity_date DATE,
        risk_level STRING NOT NULL, risk_level_standard STRING NOT NULL, currency STRING NOT NULL,
        manager STRING NOT NULL, custodian STRING, fund_manager STRING, investment_target STRING,
        investment_scope STRING, investment_strategy STRING, performance_benchmark STRING,
        benchmark_type STRING, min_purchase_amount DECIMAL(18,4), min_additional_amount DECIMAL(18,4),
        status STRING NOT NULL, data_source STRING NOT NULL, collect_date DATE NOT NULL,
        created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL""",
    "product_nav": """id BIGINT NOT NULL, product_id BIGINT NOT NULL, nav_date DATE NOT NULL,
        unit_nav DECIMAL(18,6) NOT NULL, cumulative_nav DECIMAL(18,6), daily_return DECIMAL(10,6),
        nav_type STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL""",
    "product_return": """id BIGINT NOT NULL, product_id BIGINT NOT NULL, return_period STRING NOT NULL,
        return_value DECIMAL(10,6) NOT NULL, return_type STRING NOT NULL, calc_date DATE NOT NULL,
        created_at TIMESTAMP_NTZ NOT NULL""",
    "product_fee": """id BIGINT NOT NULL, product_id BIGINT NOT NULL, fee_type STRING NOT NULL,
        fee_name STRING NOT NULL, fee_rate DECIMAL(10,6), fee_calc_method STRING, fee_details STRING,
        effective_date DATE, created_at TIMESTAMP_NTZ NOT NULL""",
    "collection_log": """id BIGINT NOT NULL, job_name STRING NOT NULL, institution_code STRING,
        start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, status STRING NOT NULL, records_count INT,
        error_message STRING, created_at TIMESTAMP_NTZ NOT NULL""",
    "market_quote": """id BIGINT NOT NULL, quote_date DATE NOT NULL, symbol_code STRING NOT NULL,
        symbol_name STRING NOT NULL, market_region STRING NOT NULL, asset_class STRING NOT NULL,
        open_price DECIMAL(18,4), high_price DECIMAL(18,4), low_price DECIMAL(18,4),
        close_price DECIMAL(18,4), prev_close DECIMAL(18,4), change_amount DECIMAL(18,4),
        change_pct DECIMAL(10,4), volume BIGINT, volume_unit STRING, amount DECIMAL(18,4),
        currency STRING NOT NULL, data_source STRING NOT NULL, source_code STRING,
        created_at TIMESTAMP_NTZ NOT NULL""",
    "holding_report": """id BIGINT NOT NULL, product_id BIGINT NOT NULL, report_date DATE NOT NULL,
        report_type STRING NOT NULL, report_period STRING, data_source STRING NOT NULL,
        created_at TIMESTAMP_NTZ NOT NULL""",
    "product_holding": """id BIGINT NOT NULL, report_id BIGINT NOT NULL, product_id BIGINT NOT NULL,
        report_date DATE NOT NULL, asset_code STRING, asset_name STRING NOT NULL, asset_type STRING NOT NULL,
        sub_type STRING, market STRING, issuer_name STRING, industry_code STRING, industry_name STRING,
        weight DECIMAL(10,6), market_value DECIMAL(18,4), share_quantity DECIMAL(18,4),
        cost_basis DECIMAL(18,6), valuation_method STRING, is_top10 BOOLEAN, sort_order INT,
        raw_data STRING, created_at TIMESTAMP_NTZ NOT NULL""",
    "product_asset_allocation": """id BIGINT NOT NULL, report_id BIGINT NOT NULL, product_id BIGINT NOT NULL,
        report_date DATE NOT NULL, asset_class STRING NOT NULL, weight DECIMAL(10,6),
        market_value DECIMAL(18,4), created_at TIMESTAMP_NTZ NOT NULL""",
    "holding_security_info": """id BIGINT NOT NULL, asset_code STRING NOT NULL, market STRING NOT NULL,
        asset_name STRING, asset_type STRING, exchange STRING, industry_code STRING, industry_name STRING,
        issuer_name STRING, listing_date DATE, status STRING, extra STRING,
        created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL""",
    "product_holding_summary": """id BIGINT NOT NULL, report_id BIGINT NOT NULL, product_id BIGINT NOT NULL,
        report_date DATE NOT NULL, top10_weight DECIMAL(10,6), stock_weight DECIMAL(10,6),
        bond_weight DECIMAL(10,6), cash_weight DECIMAL(10,6), fund_weight DECIMAL(10,6),
        derivative_weight DECIMAL(10,6), non_standard_weight DECIMAL(10,6), other_weight DECIMAL(10,6),
        concentration_score DECIMAL(10,6), holding_count INT, turnover_indicator DECIMAL(10,6),
        created_at TIMESTAMP_NTZ NOT NULL""",
    "product_manager_style": """id BIGINT NOT NULL, product_id BIGINT NOT NULL, report_date DATE NOT NULL,
        dimension STRING NOT NULL, tag STRING NOT NULL, score DECIMAL(10,6), source STRING,
        created_at TIMESTAMP_NTZ NOT NULL""",
    "similarity_cluster_run": """id STRING NOT NULL, report_date DATE NOT NULL, product_type_filter STRING,
        algorithm STRING NOT NULL, k INT NOT NULL, params_json STRING, silhouette DOUBLE, inertia DOUBLE,
        n_products BIGINT, n_features BIGINT, created_at TIMESTAMP_NTZ NOT NULL, mode STRING NOT NULL,
        baseline_run_id STRING""",
    "similarity_cluster_baseline": """cluster_run_id STRING NOT NULL, report_date DATE NOT NULL,
        product_type_filter STRING, algorithm STRING NOT NULL, k INT NOT NULL, feature_type STRING NOT NULL,
        silhouette DOUBLE, inertia DOUBLE, n_products BIGINT NOT NULL, k_search_results STRING,
        created_at TIMESTAMP_NTZ NOT NULL""",
    # The k x n centroid matrix of a baseline, one row per (cluster, feature).
    "similarity_baseline_centroids": """cluster_run_id STRING NOT NULL, cluster_id INT NOT NULL,
        feature STRING NOT NULL, value DOUBLE NOT NULL""",
    "similarity_clusters": f"""cluster_run_id STRING NOT NULL, report_date DATE NOT NULL,
        product_type_filter STRING, algorithm STRING NOT NULL, k INT NOT NULL, cluster_id INT NOT NULL,
        cluster_label STRING, size BIGINT NOT NULL, top_industries {_WEIGHTS.format(name="industry")},
        top_holdings {_WEIGHTS.format(name="asset_code")}, avg_hhi DOUBLE, avg_overlap DOUBLE,
        avg_overlap_raw DOUBLE, ac_share_dominance_ratio DOUBLE,
        institution_distribution MAP<STRING, BIGINT>, representative_products ARRAY<BIGINT>,
        representative_codes ARRAY<STRING>, representative_names ARRAY<STRING>, created_at TIMESTAMP_NTZ NOT NULL""",
    "similarity_cluster_members": """report_date DATE NOT NULL, cluster_run_id STRING NOT NULL,
        product_id BIGINT NOT NULL, cluster_id INT NOT NULL, distance_to_center DOUBLE,
        created_at TIMESTAMP_NTZ NOT NULL""",
    "index_constituent_weight": """id BIGINT NOT NULL, index_code STRING NOT NULL, index_name STRING,
        constituent_code STRING NOT NULL, constituent_name STRING, market STRING, weight DECIMAL(10,6),
        effective_date DATE NOT NULL, created_at TIMESTAMP_NTZ NOT NULL""",
    "similarity_attribution": """product_id BIGINT NOT NULL, cluster_run_id STRING NOT NULL,
        cluster_id INT NOT NULL, report_date DATE NOT NULL, start_date DATE NOT NULL, end_date DATE NOT NULL,
        benchmark_type STRING NOT NULL, benchmark_code STRING, total_return DOUBLE, benchmark_return DOUBLE,
        excess_return DOUBLE, allocation_effect DOUBLE, selection_effect DOUBLE, interaction_effect DOUBLE,
        rank_in_cluster BIGINT, created_at TIMESTAMP_NTZ NOT NULL""",
}

# Conflict keys of the idempotent appends and upserts.
NATURAL_KEYS: dict[str, list[str]] = {
    "product_info": ["institution_code", "product_code", "collect_date"],
    "product_nav": ["product_id", "nav_date"],
    "market_quote": ["quote_date", "symbol_code"],
    "holding_report": ["product_id", "report_date", "report_type"],
    # The date is part of the key so that a later quarter of the same asset is kept.
    "product_holding": ["product_id", "report_date", "asset_code", "asset_name"],
    "product_asset_allocation": ["report_id", "asset_class"],
    "holding_security_info": ["asset_code", "market"],
    "product_holding_summary": ["product_id", "report_date"],
    "product_manager_style": ["product_id", "report_date", "dimension", "tag"],
    "similarity_cluster_run": ["report_date", "algorithm", "k", "product_type_filter", "created_at"],
    "similarity_cluster_baseline": ["algorithm", "feature_type", "product_type_filter"],
    "similarity_clusters": ["cluster_run_id", "cluster_id"],
    "similarity_cluster_members": ["report_date", "product_id", "cluster_run_id"],
    "similarity_baseline_centroids": ["cluster_run_id", "cluster_id", "feature"],
    "index_constituent_weight": ["index_code", "constituent_code", "effective_date"],
    "similarity_attribution": [
        "cluster_run_id", "cluster_id", "start_date", "end_date", "benchmark_type", "benchmark_code",
    ],
}

# Facts are stored by the date every read filters on, so scans prune to the dates they need.
PARTITIONS: dict[str, list[str]] = {
    "product_info": ["collect_date"],
    "product_nav": ["nav_date"],
    "market_quote": ["quote_date"],
    "holding_report": ["report_date"],
    "product_holding": ["report_date"],
    "product_asset_allocation": ["report_date"],
    "product_holding_summary": ["report_date"],
    "product_manager_style": ["report_date"],
    "similarity_cluster_run": ["report_date"],
    "similarity_clusters": ["report_date"],
    "similarity_cluster_members": ["report_date"],
    "similarity_attribution": ["report_date"],
    # A baseline is replaced per algorithm and feature space, whatever its date.
    "similarity_cluster_baseline": ["algorithm", "feature_type"],
    "similarity_baseline_centroids": ["cluster_run_id"],
    "index_constituent_weight": ["effective_date"],
}


def schema_of(table: str) -> StructType:
    """The declared schema of one table."""
    return StructType.fromDDL(DDL[table])
