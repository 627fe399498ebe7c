"""Plan checks: pushed filters, pruned columns, no Python in column operators, no avoidable products."""

import pytest

from quantloom.plans.catalog import all_queries

COLUMN_ONLY = ["flagship_rank_spread", "volatility_pack", "characteristics_pack", "trend_fingerprint", "book_backtest", "refreshed_long_short", "trade_flow_features", "quote_features", "depth_features",
               "position_book", "signal_families", "grid_backtest", "bm25_top", "document_changes", "triple_barrier", "forward_returns", "carry_liquidation", "stress_scenarios", "permuted_paths"]


def plan(spark, sf, name):
    return all_queries()[name].fn(spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", COLUMN_ONLY)
def test_no_python_in_column_operators(spark, sf, name):
    p = plan(spark, sf, name)
    assert "ArrowEvalPython" not in p and "InPandas" not in p and "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "vwap_proxy")
    assert "IsNotNull(l_quantity)" in p and "GreaterThan(l_quantity,0.0)" in p and "l_discount" not in p and "l_returnflag" not in p


def test_bars_aggregate_by_hash(spark, sf):
    assert "SortAggregate" not in plan(spark, sf, "vwap_proxy")


def test_symbol_windows_share_one_shuffle(spark, sf):
    # one exchange for the bars aggregate, one by symbol for all nested volatility windows
    assert plan(spark, sf, "volatility_pack").count("Exchange hashpartitioning") == 2


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(spark, sf, "bm25_top")


@pytest.mark.parametrize("name", ["circular_bootstrap", "stationary_bootstrap"])
def test_bootstrap_draws_never_leave_their_task(spark, sf, name):
    """Resamples are drawn and summed inside one stage: one join of arrays by strategy before it, none after, and no exploded draws."""
    p = plan(spark, sf, name)
    before = p.index("MapInPandas")
    assert p[before:].count("Join") == 1 and p[:before].count("Join") == 0 and p[:before].count("Exchange") <= 1 and p.count("Generate") == 1 and "CartesianProduct" not in p
