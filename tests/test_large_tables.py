"""Results that only larger tables show: values beyond the range of a long, products beyond a double, ids that exist only there."""

import math

import numpy as np
from harness import compare, connect

from quantloom.operators import aggregates as ag
from quantloom.operators import overfit as of
from quantloom.operators import positions as ps
from quantloom.operators.residuals import residual_z
from quantloom.plans.catalog import all_queries
from quantloom.plans.registry import tidy
from quantloom.plans.views import bars, sectors


def test_tidy_keeps_what_no_long_holds(spark):
    xs = [3.644825217999954e38, -2e20, float("inf"), float("nan"), 0.1234567, None]
    got = [r.x for r in tidy(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double"), 5).orderBy("i").collect()]
    assert [math.isclose(got[0], xs[0], rel_tol=1e-12), math.isclose(got[1], xs[1], rel_tol=1e-12), got[2], math.isnan(got[3]), got[4], got[5]] == [True, True, float("inf"), True, 0.12346, None]


def test_trade_buckets_compound_over_many_trades(spark):
    rows = [("loss", -0.5)] * 2000 + [("gain", 1.0)] * 2000 + [("out", -1.0), ("out", 0.5), ("beyond", -1.5)]
    d = ag.trade_buckets(spark.createDataFrame(rows, "b string, net double").selectExpr("b", "net", "net AS gross", "0.0D AS cost"), "b")
    got = {r.b: r.log_compounded for r in d.collect()}
    assert math.isclose(got["loss"], 2000 * math.log(0.5)) and math.isclose(got["gain"], 2000 * math.log(2.0)) and got["out"] == float("-inf") and math.isnan(got["beyond"])


def test_citations_where_documents_pass_two_thousand(spark):
    sf = "/root/testdata/sf0.1"
    assert compare(spark, connect(sf), all_queries()["resolved_citations"], sf).startswith("ok")


def test_cooldown_folds_many_keys_in_one_pass(spark):
    rng = np.random.default_rng(5)
    rows = [(k if k else None, i, float(v)) for k in range(40) for i, v in enumerate(rng.choice([-1.0, 0.0, 0.0, 1.0], 30))]
    want = {}
    for k in range(40):
        current, entered = 0.0, -4
        for key, i, v in rows[30 * k:30 * k + 30]:
            if v == 0:
                current = 0.0
            elif v != current and i - entered >= 4:
                current, entered = v, i
            want[key, i] = current
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "7")  # a key spans batches
        d = ps.cooldown(spark.createDataFrame(rows, "symbol long, date int, p double").repartition(5), "p", 4)
        assert {(r.symbol, r.date): r.cooled for r in d.collect()} == want
    finally:
        spark.conf.set(size, before)
    assert "FlatMapGroups" not in d._jdf.queryExecution().executedPlan().toString()


def test_correlation_edges_travel_packed_and_decide_in_double_precision(spark):
    n = 2000
    unit = np.linalg.qr(np.random.default_rng(9).normal(size=(n, 7)) - 0.0)[0]
    unit -= unit.mean(axis=0)
    unit = np.linalg.qr(unit)[0]
    mix = lambda a, b, c: c * unit[:, a] + math.sqrt(1 - c * c) * unit[:, b]
    m = {"a": unit[:, 0], "above": mix(0, 1, 0.9 + 1e-9), "b": unit[:, 2], "below": mix(2, 3, 0.9 - 1e-9), "c": unit[:, 4], "minus": -3.0 * unit[:, 4]}
    r = spark.createDataFrame([(i, k, float(x)) for k, v in m.items() for i, x in enumerate(v)], "date int, strategy_id string, ret double")
    e = of.correlation_edges(r, 0.9)
    assert {frozenset((x.src, x.dst)) for x in e.collect()} == {frozenset(("a", "above")), frozenset(("c", "minus"))}
    # what is copied to the tile pairs is read from the packed table, no list of cells is gathered again
    assert "collect_list" not in e._jdf.queryExecution().executedPlan().toString()


def test_residuals_hold_no_window_per_cell(spark, sf):
    """A name's windows are cut from its packed cells inside the task; no row carries a list of the rows before it."""
    z = residual_z(bars(spark, sf), sectors(spark, sf), window=30, components=2)
    p = z._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(_r" not in p and "posexplode" not in p and "FlatMapCoGroups" in p
