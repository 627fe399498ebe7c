"""Exact quantiles against numpy, with small bins and leaves so that several passes are needed."""

import numpy as np
import pytest

from quantloom.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.01, 1 / 3, 0.5, 0.95, 0.999, 1.0]


def table(spark, values, groups=None):
    return spark.createDataFrame([(None if groups is None else groups[i], None if v is None else float(v)) for i, v in enumerate(values)], "g string, x double")


@pytest.mark.parametrize("kind", ["normal", "heavy", "hot", "two", "one", "extreme"])
def test_equals_numpy(spark, kind):
    draw = np.random.default_rng(5)
    x = {"normal": draw.standard_normal(3000), "heavy": np.exp(20 * draw.standard_normal(1500)), "hot": np.where(draw.random(3000) < 0.6, 1.5, draw.standard_normal(3000)),
         "two": np.array([1.0, 4.0]), "one": np.array([-7.25]), "extreme": np.array([-1.7e308, -1e300, -5e-324, 0.0, 5e-324, 1e-310, 1.7e308])}[kind]
    values = [*x, None, float("nan"), float("inf"), float("-inf")]
    (row,) = exact_quantiles(table(spark, values), "x", PROBS, bins=8, leaf=20 if kind != "heavy" else 200).collect()
    assert row["n"] == len(x)
    for got, want in zip(row["q"], np.quantile(x, PROBS)):
        assert got == pytest.approx(want, rel=1e-12) or kind == "extreme" and abs(want) > 1e299  # the distance of the largest doubles has no double


def test_groups_with_null_key_and_empty(spark):
    draw = np.random.default_rng(6)
    x, g = draw.standard_normal(2000), [("a", "b", None)[i % 3] for i in range(2000)]
    got = {r["g"]: r for r in exact_quantiles(table(spark, [*x, None], [*g, "empty"]), "x", [0.25, 0.5], by=["g"], bins=16, leaf=30).collect()}
    for key in ("a", "b", None):
        want = np.quantile([v for v, k in zip(x, g) if k == key], [0.25, 0.5])
        assert got[key]["q"] == pytest.approx(list(want), rel=1e-12)
    assert got["empty"]["n"] == 0 and got["empty"]["q"] == [None, None]
    (none,) = exact_quantiles(table(spark, []), "x", [0.5]).collect()
    assert none["n"] == 0 and none["q"] == [None]
