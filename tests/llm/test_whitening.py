"""Whitening against numpy's dense eigensolver, exact integers and hard rows."""

import math

import numpy as np
import pytest

from quantloom.llm import op13_whitening as op13


def brute(rows, k=4):
    """By vec_id and component, up to sign."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted(set(tuple(x) for _, x in good)), float)
    n, total = len(fit), [sum(int(v) for v in column) for column in fit.T]
    y = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        white = (np.array(x) - fit.mean(axis=0)) @ vectors / np.sqrt(values)
        for c in range(k):
            out[i, c + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, total)), white[c], values[c] / np.trace(y.T @ y / n))
    return out


def compare(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    for c in range(1, 5):
        mine = [r for r in got if r["component"] == c]
        sign = np.sign(sum(r["whitened"] * want[r["vec_id"], c][2] for r in mine))
        for r in mine:
            n, deviation, white, share = want[r["vec_id"], c]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["whitened"] * sign == pytest.approx(white, abs=1e-7)
            assert r["explained"] == pytest.approx(share, rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_equals_dense_solver(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    compare(op13.op13_embedding_whitening(spark, sf).collect(), brute([(r["vec_id"], r["embedding"]) for r in table.collect()]))


def test_hard_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.standard_normal(6) * [9, 5, 3, 2, 1, 1]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # copies count once
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] + [0.0] * 5), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [1.0, 2.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n")
    compare(op13.whiten(table).collect(), brute(rows))


def test_zero_spectrum_empty_table_and_overflow(spark):
    kind = "vec_id long, embedding array<double>"
    flat = op13.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert len(flat) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in flat)
    assert op13.whiten(spark.createDataFrame([], kind)).count() == 0
    assert op13.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    line = op13.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0, 1.0, 5.0]) for i in range(9)], kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and len(line) == 36
    huge = op13.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], kind)).collect()
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.2], [2, 1, 1, 1, 1, 1], [1e8, 1, 1e-3, 1e-4, 1e-5], [7]])
def test_slices(values):
    a = spectrum(np.array(values, float))
    a = (a + a.T) / 2
    got, vectors = op13.Slices(a).pairs(4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(got, want, rtol=1e-10, atol=1e-12 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-10)
    assert np.allclose(a @ vectors, vectors * got, atol=1e-10 * max(values))


def test_counts_follow_inertia():
    draw = np.random.default_rng(9)
    for n in (1, 2, 5, 40):
        for _ in range(20):
            a = draw.standard_normal((n, n))
            a = a + a.T
            assert op13.positive_pivots(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert op13.positive_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
