"""Block bootstraps: running sums against explicit resamples, block shapes, hard rows."""

import math

import numpy as np
import pytest

from quantloom.operators import overfit as of


def explicit(x, start, size):
    out = []
    for a, n in zip(start, size):
        sample = np.concatenate([x[(s + np.arange(k)) % len(x)] for s, k in zip(a, n)])
        assert len(sample) == len(x)
        out.append(0.0 if (sample == sample[0]).all() else sample.mean() / sample.std(ddof=1) * math.sqrt(252))
    return np.array(out)


@pytest.mark.parametrize("blocks", [of.circular_blocks, of.geometric_blocks])
@pytest.mark.parametrize("t, length", [(2, 1), (5, 2), (97, 5), (250, 6), (30, 30)])
def test_running_sums_equal_explicit_resamples(blocks, t, length):
    x = np.random.default_rng(t).standard_normal(t) * 0.01 + 0.0005
    start, size = blocks(12345, t, length, 3, np.arange(40))
    assert (size.sum(axis=1) == t).all() and ((0 <= start) & (start < t)).all()
    np.testing.assert_allclose(of.resampled_sharpes(x, start, size), explicit(x, start, size), rtol=1e-8, atol=1e-8)


def test_resamples_without_spread_are_zero():
    x = np.array([0.0] * 40 + [0.01])
    start, size = of.circular_blocks(7, len(x), 1, 0, np.arange(300))
    want = explicit(x, start, size)
    assert (want == 0).any()
    np.testing.assert_allclose(of.resampled_sharpes(x, start, size), want, rtol=1e-8, atol=1e-8)


def test_geometric_lengths_have_the_stated_mean():
    _, size = of.geometric_blocks(1, 100_000, 20, 0, np.arange(4))
    inner = size[0][:1000]
    assert inner[inner > 0].mean() == pytest.approx(20, rel=0.15)


def test_table_with_short_constant_and_broken_series(spark):
    rows = [(d, "a", math.sin(d * 1.7) * 0.01 + 0.001) for d in range(200)] + [(d, "b", 0.01) for d in range(50)] + [(d, "c", 0.02 * d) for d in range(4)]
    rows += [(d, "d", float("nan") if d % 2 else None) for d in range(10)] + [(d, "e", 0.01 * (-1) ** d if d < 30 else float("inf")) for d in range(40)]
    table = spark.createDataFrame(rows, "date int, strategy_id string, ret double")
    got = {r["strategy_id"]: r for r in of.circular_bootstrap(table, resamples=600).collect()}
    assert {k: (r["status"], r["resamples"], r["observations"]) for k, r in got.items()} == {
        "a": ("computed", 600, 200), "b": ("computed", 600, 50), "c": ("not_enough_observations", 0, 4), "d": ("not_enough_observations", 0, 0), "e": ("computed", 600, 30)}
    assert got["a"]["ci_lower_95"] < got["a"]["point_sharpe"] < got["a"]["ci_upper_95"]
    assert (got["b"]["ci_lower_95"], got["b"]["ci_upper_95"]) == (0, 0)
    x = np.array([r[2] for r in rows if r[1] == "a"])
    wide = {r["strategy_id"]: r for r in of.stationary_bootstrap(table, resamples=4000).collect()}["a"]
    draw = np.random.default_rng(1)
    naive = []
    for _ in range(4000):
        index, p = np.empty(200, int), 1 / wide["block_length"]
        at = draw.integers(200)
        for i in range(200):
            index[i] = at
            at = draw.integers(200) if draw.random() < p else (at + 1) % 200
        s = x[index]
        naive.append(s.mean() / s.std(ddof=1) * math.sqrt(252))
    low, high = np.percentile(naive, [2.5, 97.5])
    assert wide["ci_lower_95"] == pytest.approx(low, abs=0.12 * (high - low)) and wide["ci_upper_95"] == pytest.approx(high, abs=0.12 * (high - low))


def test_resamples_stay_in_the_task_of_their_strategy(spark):
    rows = [(d, f"s{k}", math.sin(d * (1.1 + k)) * 0.01) for k in range(3) for d in range(120)]
    table = spark.createDataFrame(rows, "date int, strategy_id string, ret double")
    d = of.stationary_bootstrap(table, resamples=1100)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "sharpes" not in plan  # one row per strategy goes in, one comes out
    got = {r["strategy_id"]: r for r in d.collect()}
    assert sorted(got) == ["s0", "s1", "s2"] and all(r["resamples"] == 1100 and r["ci_lower_95"] < r["ci_upper_95"] for r in got.values())
    x = np.random.default_rng(5).standard_normal(997)
    np.testing.assert_allclose(of.linear_quantiles(x, (0.0, 0.025, 0.5, 0.975, 1.0)), np.quantile(x, [0.0, 0.025, 0.5, 0.975, 1.0]), rtol=1e-12)


@pytest.mark.parametrize("length", [1, 2, 8])
def test_block_lengths_are_geometric(length):
    _, size = of.geometric_blocks(3, 50_000, length, 1, np.arange(4))
    inner = size[:, :2000].ravel()  # the last blocks are cut
    for k in range(1, 6):
        assert (inner == k).mean() == pytest.approx((1 - 1 / length) ** (k - 1) / length, abs=0.025)
