import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

# quick queries of every family; check.py runs all of them
NAMES = [
    "idx_daily_board", "agg_top10_hhi", "agg_confusion", "agg_kpi", "fn_scenario", "fn_classify_coin", "fn_is_regulatory", "fn_transform_liquidity",
    "join_asof_nearest", "join_asof_lagged", "join_snapshot", "win_peg_volatility", "win_ewma_cov", "win_rolling_stats", "src_observations_json",
    "sink_reconcile", "ts_auroc_documents", "ts_naive_benchmarks", "topk_headlines", "set_distinct_first", "str_daily_window", "str_dedup", "wt_critic",
    "wt_pca", "wt_pca_tests", "wt_pca_transform", "ts_collinearity", "udf_special", "agg_correlation_p_values", "idx_calibrate_regime", "idx_regime_full", "ts_proxy", "ts_validation_run",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert cols == sorted(names)
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["series_id", "ds", "idx", "avg_30", "alert_level", "trend"]


def test_no_cross_join_in_grid_plans(spark, sf):
    for name in ("ts_weight_sens", "ts_ablation", "idx_fit_ces_rho", "join_cross_grid"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_date_filter_and_columns_reach_the_scan(spark, sf):
    plan = entry.queries()["filter_date_range"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orde" in plan  # the text is cut there
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_stored_panel_is_scanned_once(spark, sf):
    plan = entry.queries()["ts_bootstrap_mbb"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
