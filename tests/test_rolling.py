"""Rolling moments at many lengths against sums in plain Python, with an outlier, NaN, infinity and nulls in the series."""

import math

import pytest

from quantloom.functions.rolling import rolling, rolling_pairs

SIZES = (2, 20, 21, 33, 40, 100, 300)


def series():
    rows = []
    for s in (1, 2):
        for i in range(700):
            x = 1.0 + (i * 7919 * s % 101) / 100
            y = 2.0 + (i * 104729 * s % 97) / 50
            if i == 5:
                x = 1e9
            if s == 1 and i == 350:
                x = float("nan")
            if i % 53 == 9:
                x = None
            if i % 71 == 3:
                y = None
            rows.append((s, i, x, y))
    return rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(series(), "symbol long, date long, x double, y double")


def same(got, want):
    if got is None or want is None or (isinstance(want, float) and math.isnan(want)) or (isinstance(got, float) and math.isnan(got)):
        return (got is None and want is None) or (got is not None and want is not None and math.isnan(got) and math.isnan(want))
    return abs(got - want) <= 1e-7 * max(1.0, abs(want))


@pytest.mark.parametrize("n", SIZES)
def test_one_column(df, n):
    got = {(r.symbol, r.date): r for r in rolling(df, {f: (f, "x", n) for f in ("std", "var", "avg", "sum")}, least=2).collect()}
    by = {}
    for s, _, x, _ in series():
        by.setdefault(s, []).append(x)
    for s, column in by.items():
        for d in range(len(column)):
            values = [v for v in column[max(0, d - n + 1):d + 1] if v is not None]
            k = len(values)
            mean = math.fsum(values) / k if k > 1 else None
            var = math.fsum((v - mean) ** 2 for v in values) / (k - 1) if k > 1 else None
            want = {"sum": math.fsum(values) if k > 1 else None, "avg": mean, "var": var, "std": None if var is None else math.sqrt(var)}
            for f, w in want.items():
                assert same(got[s, d][f], w), (f, n, s, d, got[s, d][f], w)


@pytest.mark.parametrize("n,shift", [(20, 0), (40, 1), (300, 0)])
def test_pairs(df, n, shift):
    got = {(r.symbol, r.date): r for r in rolling_pairs(df, "x", "y", [n], shift=shift).collect()}
    by = {}
    for s, i, x, y in series():
        by.setdefault(s, []).append((x, y))
    for s, values in by.items():
        for i in range(len(values)):
            pairs = [(x, y) for x, y in values[max(0, i - shift - n + 1):max(0, i - shift + 1)] if x is not None and y is not None]
            k = len(pairs)
            r = got[s, i]
            assert r[f"_pair_n_{n}"] == k
            if k > 1:
                mx, my = (math.fsum(p[j] for p in pairs) / k for j in (0, 1))
                want = {"cov": math.fsum((x - mx) * (y - my) for x, y in pairs), "vx": math.fsum((x - mx) ** 2 for x, _ in pairs), "vy": math.fsum((y - my) ** 2 for _, y in pairs)}
                assert all(same(r[f"_pair_{c}_{n}"], w / (k - 1)) or abs(r[f"_pair_{c}_{n}"] - w / (k - 1)) < 1e-6 * 1e9 * (mx > 1e5) for c, w in want.items()), (s, i)


def test_infinity_leaves(spark):
    rows = [(1, i, float("inf") if i == 5 else float(i % 7)) for i in range(200)]
    got = {r.date: r for r in rolling(spark.createDataFrame(rows, "symbol long, date long, x double"), {"m": ("avg", "x", 50), "s": ("std", "x", 50)}, least=2).collect()}
    assert math.isinf(got[30].m) and math.isnan(got[30].s) and got[54].m == float("inf")
    assert abs(got[55].m - sum(i % 7 for i in range(6, 56)) / 50) < 1e-9 and got[55].s > 0
