"""Models, resampling and overfitting statistics against numpy on small fixtures."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models as ml
from quantloom.operators import overfit as of
from quantloom.operators import splits as sp
from quantloom.operators.residuals import residual_z

RNG = np.random.default_rng(11)


def long_returns(spark, t=160, s=12, signal=0.0):
    m = RNG.normal(0, 0.01, (t, s))
    m[:, 0] += signal
    d = pd.bdate_range("2020-01-01", periods=t).date
    pdf = pd.DataFrame([(d[i], f"s{j:02d}", m[i, j]) for i in range(t) for j in range(s)], columns=["date", "strategy_id", "ret"])
    return m, spark.createDataFrame(pdf)


def brute_pbo(m, p):
    sub = len(m) // p
    blocks = [m[i * sub:(i + 1) * sub] for i in range(p)]
    logits, neg = [], 0
    for c in itertools.combinations(range(p), p // 2):
        a, b = np.vstack([blocks[i] for i in c]), np.vstack([blocks[i] for i in range(p) if i not in c])
        i, o = a.mean(0) / a.std(0, ddof=1), b.mean(0) / b.std(0, ddof=1)
        w = (1 + (o < o[i.argmax()]).sum()) / (m.shape[1] + 1)
        logits.append(np.log(w / (1 - w)))
        neg += o[i.argmax()] < 0
    return np.mean(np.array(logits) <= 0), np.median(logits), neg / len(logits)


def test_pbo_equals_brute_force(spark):
    m, r = long_returns(spark)
    got, want = of.pbo(r, 8).first(), brute_pbo(m, 8)
    assert got.n_splits == 70 and got.n_strategies == 12
    np.testing.assert_allclose([got.pbo, got.median_logit, got.failure_rate], want, atol=1e-9)


def test_pbo_of_noise_and_of_a_real_edge(spark):
    assert 0.15 < np.mean([of.pbo(long_returns(spark, 240, 20)[1], 6).first().pbo for _ in range(4)]) < 0.85
    assert of.pbo(long_returns(spark, 240, 20, signal=0.01)[1], 6).first().pbo == 0.0


def test_missing_days_count_as_zero(spark):
    m, r = long_returns(spark, 80, 5)
    keep = r.filter((F.col("strategy_id") != "s03") | (F.dayofmonth("date") % 3 != 0))
    d = sorted({x.date for x in r.select("date").collect()})
    m[[i for i, x in enumerate(d) if x.day % 3 == 0], 3] = 0.0
    np.testing.assert_allclose(of.pbo(keep, 4).first().median_logit, brute_pbo(m, 4)[1], atol=1e-9)


def test_components_and_edges(spark):
    m, _ = long_returns(spark, 120, 6)
    m[:, 3], m[:, 5] = m[:, 0] * 2, -m[:, 1]
    pdf = pd.DataFrame([(i, f"s{j}", m[i, j]) for i in range(120) for j in range(6)], columns=["date", "strategy_id", "ret"])
    r = spark.createDataFrame(pdf)
    c = {x.strategy_id: x.cluster for x in of.components(r.select("strategy_id").distinct(), of.correlation_edges(r, 0.9, tile=2)).collect()}
    assert c == {"s0": "s0", "s3": "s0", "s1": "s1", "s5": "s1", "s2": "s2", "s4": "s4"}


@pytest.mark.parametrize("tile", [2, 256])
def test_chain_of_correlated_strategies_is_one_cluster(spark, tile):
    rng, n = np.random.default_rng(4), 4000
    walk = rng.normal(size=(n, 4))
    angle = np.arccos(0.94)
    unit = np.linalg.qr(walk)[0]
    chain = {2: 0, 5: 1, 6: 2, 1: 3}  # neighbours 0.94, all others below 0.9
    m = {k: np.cos(i * angle) * unit[:, 0] + np.sin(i * angle) * unit[:, 1] for k, i in chain.items()}
    r = spark.createDataFrame(pd.DataFrame([(i, f"s{k}", float(v[i])) for k, v in m.items() for i in range(n)], columns=["date", "strategy_id", "ret"]))
    c = of.components(r.select("strategy_id").distinct(), of.correlation_edges(r, 0.9, tile=tile))
    assert c.select("cluster").distinct().count() == 1


def test_components_that_do_not_rest_raise(spark):
    e = spark.createDataFrame([(f"n{i + 1:03d}", f"n{i:03d}") for i in range(40)], "src string, dst string")
    with pytest.raises(RuntimeError):
        of.components(spark.createDataFrame([(f"n{i:03d}",) for i in range(41)], "strategy_id string"), e, max_rounds=1)


def test_chain_of_copies_is_one_component(spark):
    e = spark.createDataFrame([(f"n{i + 1:03d}", f"n{i:03d}") for i in range(40)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(41)], "strategy_id string")
    assert of.components(nodes, e).select("cluster").distinct().count() == 1


def test_pareto_front_equals_brute_force(spark):
    v = RNG.integers(0, 8, (200, 3)).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"strategy_id": [f"s{i}" for i in range(200)], "a": v[:, 0], "b": v[:, 1], "c": v[:, 2]}))
    want = {f"s{i}" for i in range(200) if not any(v[j, 0] >= v[i, 0] and v[j, 1] <= v[i, 1] and v[j, 2] <= v[i, 2] and tuple(v[j]) != tuple(v[i]) for j in range(200))}
    for tile, guards in ((2048, 16), (20, 16), (5, 0), (1, 1)):
        assert {r.strategy_id for r in of.pareto_front(d, "a", ["b", "c"], tile=tile, guards=guards).collect()} == want
    # on a sphere every point stays, so the front is cut into ranges that do meet
    x = np.abs(RNG.normal(size=(300, 3)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame(pd.DataFrame({"strategy_id": [f"s{i}" for i in range(300)], "a": x[:, 0], "b": -x[:, 1], "c": -x[:, 2]}))
    assert of.pareto_front(d, "a", ["b", "c"], tile=40).count() == 300
    assert of.pareto_front(d.limit(0), "a", ["b", "c"]).count() == 0


def test_bootstrap_intervals_hold_the_point(spark):
    _, r = long_returns(spark, 250, 3, signal=0.003)
    for row in of.stationary_bootstrap(r, resamples=400).collect():
        assert row.ci_lower_95 < row.point_sharpe < row.ci_upper_95 and row.resamples == 400
    a, b = (of.stationary_bootstrap(r, resamples=300).orderBy("strategy_id").collect() for _ in range(2))
    assert a == b


def test_permutation_p_value(spark):
    d = spark.createDataFrame([(-1, 2.0), (0, 1.0), (1, 2.5), (2, 0.5)], "perm_id int, best_sharpe double")
    assert of.permutation_p_value(d).first().p_value == 0.5


def test_ridge_walk_forward_equals_numpy(spark):
    n, k = 600, 4
    x, day = RNG.normal(0, 2, (n, k)) + 3, np.repeat(np.arange(60), 10)
    y = x @ [0.5, -0.2, 0.0, 0.1] + RNG.normal(0, 1, n)
    dates = pd.bdate_range("2020-01-01", periods=60).date
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(k)]).assign(date=dates[day], y=y, row=np.arange(n))
    rows = spark.createDataFrame(pdf)
    folds = sp.walk_forward(rows, 30, 10, 10)
    got = ml.ridge_walk_forward(rows, folds, [f"f{i}" for i in range(k)], "y", alpha=2.0).toPandas()
    assert set(got["fold"]) == {0, 1, 2}
    for f in range(3):
        tr, te = day < 30 + 10 * f, (day >= 30 + 10 * f) & (day < 40 + 10 * f)
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - m) / s
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(k), z.T @ (y[tr] - y[tr].mean()))
        np.testing.assert_allclose(got[got.fold == f].sort_values("row")["prediction"], (x[te] - m) / s @ w + y[tr].mean(), rtol=1e-8)


def test_stack_weights_are_non_negative(spark):
    y = RNG.normal(0, 1, 400)
    pdf = pd.DataFrame({"y": y, "good": y + RNG.normal(0, 0.3, 400), "bad": -y, "w": 1.0})
    w = ml.stack_weights(spark.createDataFrame(pdf), ["good", "bad"], "y")
    assert w["good"] == 1.0 and w["bad"] == 0.0
    assert ml.active_models(spark.createDataFrame(pdf), ["good", "bad"], "y", "w") == ["good"]


def test_univariate_auc(spark):
    x, h = RNG.integers(0, 5, 500).astype(float), RNG.integers(0, 2, 500)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "shift": x + 3 * h, "h": h}))
    got = {r.feature: r.auc for r in ml.univariate_auc(d, ["x", "shift"], "h").collect()}
    want = {c: np.mean([(a > b) + 0.5 * (a == b) for a in v[h == 1] for b in v[h == 0]]) for c, v in (("x", x), ("shift", x + 3 * h))}
    for c in got:
        assert abs(got[c] - max(want[c], 1 - want[c])) < 1e-9


def test_states_find_the_calm_regime(spark):
    r = np.concatenate([RNG.normal(0.002, 0.005, 150), RNG.normal(-0.004, 0.03, 150)])
    pdf = pd.DataFrame({"symbol": 1, "date": pd.bdate_range("2020-01-01", periods=300).date, "log_return": r, "vol": pd.Series(r).rolling(10, min_periods=1).std().fillna(0.005)})
    s = ml.regime_states(spark.createDataFrame(pdf), ["log_return", "vol"], ["symbol"]).toPandas().sort_values("date")
    assert s["risk_on"][:150].mean() > 0.8 and s["risk_on"][150:].mean() < 0.2


def test_residual_z_equals_svd(spark):
    t, s, n, k = 60, 7, 15, 2
    c = 100 * np.exp(np.cumsum(RNG.normal(0, 0.02, (t, s)), axis=0))
    d = pd.bdate_range("2020-01-01", periods=t).date
    bars = spark.createDataFrame(pd.DataFrame([(j, d[i], c[i, j]) for i in range(t) for j in range(s)], columns=["symbol", "date", "close"]))
    sec = spark.createDataFrame([(j, "a") for j in range(s)], "symbol long, sector string")
    got = residual_z(bars, sec, window=n, components=k, block_dates=8).toPandas()
    r = np.vstack([np.zeros(s), np.diff(np.log(c), axis=0)])
    assert len(got) == (t - n) * s
    for i in range(n, t):
        w = r[i - n:i]
        x = w - w.mean(0)
        v = np.linalg.svd(x, full_matrices=False)[2][:k]
        today = r[i] - w.mean(0)
        want = (today - today @ v.T @ v) / np.std(x - x @ v.T @ v, ddof=1)
        np.testing.assert_allclose(got[got.date == d[i]].sort_values("symbol")["residual_z"], want, rtol=1e-6, atol=1e-9)


def test_combinatorial_splits_purge_and_embargo(spark):
    d = spark.createDataFrame(pd.DataFrame({"date": pd.bdate_range("2020-01-01", periods=160).date}))
    f = sp.combinatorial_splits(d, horizon=3, embargo=4).toPandas()
    assert f["split"].nunique() == 28
    pos = {x: i for i, x in enumerate(sorted(d.toPandas()["date"]))}
    for _, g in f.groupby("split"):
        test, train = {pos[x] for x in g[g.role == "test"]["date"]}, {pos[x] for x in g[g.role == "train"]["date"]}
        assert not test & train
        assert not any(t + h in test for t in train for h in range(4))
        assert not train & set(range(max(test) + 1, max(test) + 5))
