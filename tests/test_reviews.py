"""Gates, reviews and fitted models on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.operators import gates as gt
from quantloom.operators import reviews as rv

GOOD = dict(data_quality_label="pit_safe", holdout_days=800, capture_ratio=0.99, unknown_exits=0, net_sharpe=1.2, family_sharpe=0.5, index_sharpe=0.6, max_drawdown=-0.1, borrow_x2_sharpe=0.4, borrow_x3_return=0.1,
            overlay_sharpe=0.3, windows_consistent=True, stock_violation=False, month_violation=False, sector_violation=False, checks_green=True, artifacts_complete=True)
TYPES = "data_quality_label string, holdout_days long, capture_ratio double, unknown_exits long, net_sharpe double, family_sharpe double, index_sharpe double, max_drawdown double, borrow_x2_sharpe double, borrow_x3_return double, overlay_sharpe double, windows_consistent boolean, stock_violation boolean, month_violation boolean, sector_violation boolean, checks_green boolean, artifacts_complete boolean"


def test_each_rule_of_the_success_gate_fails_alone(spark):
    cases = [({}, []), (dict(holdout_days=755), ["holdout_length"]), (dict(capture_ratio=0.9), ["exit_audit"]), (dict(unknown_exits=1), ["exit_audit"]), (dict(capture_ratio=0.1, data_quality_label="partial_pit_universe"), []),
             (dict(data_quality_label="unknown"), ["data_quality"]), (dict(data_quality_label="survivorship_prototype_only", net_sharpe=0.0), ["suspended"]), (dict(net_sharpe=0.69, family_sharpe=0.1, index_sharpe=0.1), ["standalone_sharpe"]),
             (dict(family_sharpe=0.9), ["beats_family"]), (dict(family_sharpe=-0.1, net_sharpe=0.7, index_sharpe=-1.0), []), (dict(index_sharpe=1.2), ["beats_index"]), (dict(max_drawdown=-0.26), ["drawdown"]), (dict(borrow_x2_sharpe=0.0), ["borrow_x2"]),
             (dict(borrow_x3_return=None), ["borrow_x3"]), (dict(overlay_sharpe=1.2), ["beats_overlay"]), (dict(month_violation=True, checks_green=False), ["month_share", "checks_green"]), (dict(max_drawdown=float("nan")), ["drawdown"])]
    rows = [tuple({**GOOD, **c}[k] for k in gt.SUCCESS_COLUMNS) + (i,) for i, (c, _) in enumerate(cases)]
    got = {r.i: r for r in gt.success_gate(spark.createDataFrame(rows, TYPES + ", i int")).collect()}
    for i, (_, failures) in enumerate(cases):
        assert (got[i].failures, got[i].passed, got[i].suspended) == (failures, not failures, failures == ["suspended"]), cases[i]


def test_perp_blockers_and_missing_numbers(spark):
    t = "i int, pbo_probability double, bootstrap_ci_lower_95 double, deflated_sharpe_probability double, net_daily_sharpe double, net_total_return double, cost_2x_net_total_return double, delay_1_event_net_total_return double, concentration_blocker boolean"
    rows = [(0, 0.2, 0.1, None, 2.0, 0.3, 0.1, 0.1, None), (1, None, 0.0, 0.9, 1.4, 0.0, None, -0.1, True)]
    a, b = gt.perp_candidates(spark.createDataFrame(rows, t)).orderBy("i").collect()
    assert a.research_candidate and not a.promotion_eligible and a.blockers == ["free_data_research_only"]
    assert not b.research_candidate and b.blockers == [n for n, _ in gt.perp_rules()] + ["free_data_research_only"]


def test_validation_classes_and_status(spark):
    names = ["pbo", "dsr", "sharpe_base", "sharpe_cost_x2", "bootstrap_lower", "sharpe_delay_1", "sharpe_delay_2", "max_month_share", "dev_sharpe", "sharpe_random", "sharpe_inverted", "holdout_sharpe"]
    good = dict(zip(names, [0.1, 0.99, 1.0, 0.5, 0.2, 0.8, 0.7, 0.2, 1.0, 0.1, -1.0, 0.6]))
    cases = [({}, [], "research_pass"), (dict(dev_sharpe=0.4), [], "none"), (dict(pbo=0.6, dsr=0.1), ["high_pbo", "low_dsr"], "none"), (dict(sharpe_delay_2=0.4), ["delay_stress_fail"], "none"), (dict(sharpe_random=0.95), ["randomization_fail"], "none"),
             (dict(holdout_sharpe=-0.1, max_month_share=0.9), ["single_period_dominance", "holdout_failure"], "none"), (dict(bootstrap_lower=None), ["insufficient_sample"], "none")]
    d = spark.createDataFrame([(i, *[{**good, **c}[n] for n in names]) for i, (c, _, _) in enumerate(cases)], "i int, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r for r in gt.validation_status(d).collect()}
    assert [(got[i].failure_classes, got[i].status) for i in range(len(cases))] == [(f, s) for _, f, s in cases]
    assert {r.i: r.status for r in gt.validation_status(d, new_source=True).collect() if r.i < 2} == {0: "promotion_eligible", 1: "research_pass"}


def test_allocator_decision_names_the_first_failure(spark):
    d = spark.createDataFrame([(0, True, True, True, True, True), (1, True, True, False, False, True), (2, False, True, False, True, True), (3, True, True, True, True, None)], "i int, " + ", ".join(f"{g} boolean" for g, _ in gt.ALLOCATOR_CLASSES))
    assert [(r.failure, r.advance) for r in gt.allocator_decision(d).orderBy("i").collect()] == [("none", True), ("subsumed_by_benchmark", False), ("regime_concentration", False), ("crisis_insurance_only", False)]


def test_basket_without_a_group_is_the_rest(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(k)
    rows = [(f"{g}{i}", g, day(k), ((k * 7 + i * 3 + ord(g)) % 11 - 5) / 500) for k in range(40) for g in "abc" for i in range(3) if not (g == "c" and k < 5) and not (g != "c" and k == 39)]
    d = spark.createDataFrame(rows, "symbol string, sector string, date date, net_return double")
    got = {(r.excluded, r.start): r for r in rv.leave_group_out(d, "sector", ["a", "b", "c"], [("all", "2020-01-01"), ("late", "2020-01-21")]).collect()}
    for out in ("none", "a", "b", "c"):
        for start, first in (("all", 0), ("late", 20)):
            total, n = 1.0, 0
            for k in range(first, 40):
                x = [r for _, g, t, r in rows if t == day(k) and g != out]
                if x:
                    total, n = total * (1 + sum(x) / len(x)), n + 1
            assert got[out, start].n_days == n and abs(got[out, start].total_return - (total - 1)) < 1e-12
    s = {(r.kind, r.name): r.share for r in rv.pnl_shares(d, "sector").collect()}
    assert abs(sum(v for (k, _), v in s.items() if k == "group") - 1) < 1e-9


def test_random_placebo_is_keyed(spark):
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(k), ((k * 13 + s) % 17 - 8) / 400, float((k + s) % 3 - 1)) for s in range(3) for k in range(400)]
    d = spark.createDataFrame(rows, "symbol int, date date, ret double, signal double")
    a, b = (sorted((r.symbol, round(r.sharpe_random, 9), round(r.dev_sharpe, 9), r.n_dev, r.n_holdout) for r in rv.validation_metrics(x, "2020-10-01").select("*", F.lit(1)).collect()) for x in (d, d.repartition(7)))
    assert a == b and all(r[3] == 274 and r[4] == 126 for r in a)


def learning_rows(spark, n=3000):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1]
    y = 0.3 + x @ [0.5, -0.04, 2.0] + rng.normal(size=n) * 0.2 + (rng.random(n) < 0.05) * 8
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i // 10), i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "date date, symbol int, a double, b double, c double, y double")


def test_stochastic_huber_meets_the_batch_fit(spark):
    import numpy as np

    from quantloom.operators import learners as ln
    from quantloom.operators import models as ml
    x, y, d = learning_rows(spark)
    m, s = x.mean(0), x.std(0)
    z, w = np.column_stack([np.ones(len(x)), (x - m) / s]), np.zeros(4)
    for _ in range(4000):
        w -= 0.3 * (z.T @ np.clip(z @ w - y, -0.1, 0.1) / len(z) + 1e-4 * np.append(0, w[1:]))
    fit = ln.HuberSGD("y", tol=1e-6).fit(ml.assembler(["a", "b", "c"]).transform(d))
    got = np.append(fit.intercept + fit.coefficients @ m, fit.coefficients * s)
    assert np.abs(got - w).max() < 0.02
    assert np.abs(fit.coefficients - [0.5, -0.04, 2.0]).max() < 0.1  # the outliers do not pull


def test_tail_holds_whole_newest_dates(spark):
    from quantloom.operators import learners as ln
    d = spark.createDataFrame([(dt.date(2020, 1, k),) for k in range(1, 11) for _ in range(10 if k < 10 else 30)], "date date")
    flags = {r.date.day: r.tail for r in ln.time_tail(d, 0.3).distinct().collect()}
    assert [k for k in flags if flags[k]] == [10]
    assert {r.date.day for r in ln.time_tail(d, 0.35).filter("tail").distinct().collect()} == {9, 10}


def test_stopped_trees_and_the_stored_artifact(spark, tmp_path):
    import pytest
    from pyspark.ml import PipelineModel

    from quantloom.operators import learners as ln
    from quantloom.operators import models as ml
    from quantloom.sources.tables import ContractError
    feats = ["a", "b", "c"]
    _, _, d = learning_rows(spark, 1200)
    x = ml.assembler(feats).transform(d.withColumn("label", F.when(F.col("c") > 0.05, 2).when(F.col("c") < -0.05, 0).otherwise(1)))
    classes = ln.StoppedClasses("label", 3, rounds=12, tol=0.05).fit(x)
    assert all(1 <= n < 12 for n in classes.rounds().values())
    assert classes.transform(x).filter("prediction = label").count() > 0.95 * x.count() and classes.importances().argmax() == 2
    trees = ln.StoppedTrees("y", rounds=15, tol=0.05).fit(x)
    assert trees.getNumTrees < 15
    model, path = PipelineModel([ml.assembler(feats), trees]), str(tmp_path / "artifact")
    ln.save_artifact(model, path, feats, "y", spark)
    want = [r.prediction for r in ml.score_frame(d, model).orderBy("symbol").collect()]
    got = ln.score_stored(d, path).orderBy("symbol").collect()
    assert [r.prediction for r in got] == want and all(r.prediction_abs == abs(r.prediction) for r in got)
    with pytest.raises(Exception, match="c"):
        ln.score_stored(d.drop("c"), path)
    extra = next((tmp_path / "artifact" / "model").rglob("*.parquet"))
    (extra.parent / "part-added.parquet").write_bytes(extra.read_bytes())
    with pytest.raises(ContractError):
        ln.load_artifact(spark, path)
