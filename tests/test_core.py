"""Helpers against brute force: block windows, split ranks, linear-time rolling, EWMA, position book folds."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import ContractError, align_to_bar, clip, div, next_weekday, require_columns
from quantloom.functions.normal import norm_cdf, norm_ppf
from quantloom.functions.rolling import rolling, rolling_pairs
from quantloom.operators import features as ft
from quantloom.operators import positions as ps
from quantloom.operators import signals as sg
from quantloom.operators import ticks as tk
from quantloom.operators.blocks import blocked, numbered
from quantloom.operators.ranks import ordinal, scaled_ranks

RNG = np.random.default_rng(7)


def hot_ticks(spark, n=900):
    """One symbol holds most rows; several rows share a timestamp."""
    sym = np.where(RNG.random(n) < 0.8, 1, RNG.integers(2, 6, n))
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(RNG.integers(0, 40_000, n) * 2, unit="s")
    return spark.createDataFrame(pd.DataFrame({"symbol": sym, "event_time": t, "trade_id": np.arange(n), "price": 100 + RNG.normal(0, 1, n).cumsum() * 0.1 + 50,
                                               "size": RNG.integers(1, 9, n).astype(float), "aggressor_sign": RNG.choice([-1.0, 1.0], n)}))


def panel(spark, symbols=3, n=300):
    d = pd.bdate_range("2020-01-01", periods=n).date
    rows = []
    for s in range(symbols):
        c = 100 * np.exp(np.cumsum(RNG.normal(0, 0.02, n)))
        rows.append(pd.DataFrame({"symbol": s, "date": d, "open": c * 0.99, "high": c * 1.02, "low": c * 0.97, "close": c, "volume": RNG.integers(100, 900, n).astype(float)}))
    return spark.createDataFrame(pd.concat(rows))


def test_numbered_equals_row_number(spark):
    t = hot_ticks(spark)
    got = numbered(t, ties=["trade_id"]).withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy("event_time", "trade_id")) - 1)
    assert got.filter("rn <> _idx").count() == 0 and got.count() == t.count()


@pytest.mark.parametrize("block", [7, 16, 64])
def test_blocked_windows_equal_plain_windows(spark, block):
    t = hot_ticks(spark)
    small = tk.trade_flow_features(t, horizons=(1, 5), windows=(3, 6), ties=["trade_id"], block_rows=block)
    whole = tk.trade_flow_features(t, horizons=(1, 5), windows=(3, 6), ties=["trade_id"])
    cols = ["trade_id", "ofi_6", "ret_6", "realized_vol_6", "signed_count_imb_3", "future_mid_return_5", "future_best_ask_1"]
    a, b = (x.select(cols).toPandas().sort_values("trade_id").reset_index(drop=True) for x in (small, whole))
    pd.testing.assert_frame_equal(a, b, atol=1e-9)


def test_blocked_rejects_no_rows(spark):
    t = hot_ticks(spark)
    out = blocked(t, lambda d, over: d.withColumn("p", F.lag("price").over(over())), back=1, ties=["trade_id"], block_rows=5)
    assert out.count() == t.count()


def test_ordinal_with_ties_nulls_and_a_hot_group(spark):
    n = 2000
    pdf = pd.DataFrame({"date": np.where(RNG.random(n) < 0.7, "a", "b"), "symbol": np.arange(n), "x": np.where(RNG.random(n) < 0.3, 0.0, RNG.normal(0, 1e-3, n) * 10.0 ** RNG.integers(-4, 6, n))})
    pdf.loc[pdf.index % 17 == 0, "x"] = None
    d = spark.createDataFrame(pdf)
    for desc in (False, True):
        key = (-F.col("x") if desc else F.col("x")).asc_nulls_last()
        got = ordinal(d, "x", "r", descending=desc, size="n").withColumn("e", F.row_number().over(W.partitionBy("date").orderBy(key, "symbol"))).withColumn("c", F.count(F.lit(1)).over(W.partitionBy("date")))
        assert got.filter("r <> e OR n <> c").count() == 0


def test_scaled_ranks_mask_nulls_but_count_them(spark):
    d = spark.createDataFrame([("d", 1, 3.0, True), ("d", 2, None, True), ("d", 3, 1.0, True), ("d", 4, 9.0, False)], "date string, symbol int, x double, u boolean")
    got = {r.symbol: r.rank_x for r in scaled_ranks(d, ["x"], "u").collect()}
    assert got == {1: 0.0, 2: None, 3: -0.5, 4: None}


def test_rolling_equals_frames_with_nulls(spark):
    d = panel(spark).withColumn("x", F.when(F.dayofmonth("date") % 9 != 0, F.col("close") + 1e6))
    got = rolling(d, {"m": ("avg", "x", 40), "s": ("std", "x", 40), "t": ("sum", "x", 25), "v": ("var", "volume", 21), "k": ("std", "x", 5)}, least=None).toPandas()
    pdf = d.toPandas().sort_values(["symbol", "date"])
    g = pdf.groupby("symbol")
    want = pd.DataFrame({"m": g["x"].transform(lambda s: s.rolling(40, min_periods=40).mean()), "v": g["volume"].transform(lambda s: s.rolling(21, min_periods=21).var())})
    got = got.sort_values(["symbol", "date"]).reset_index(drop=True)
    assert got["m"].isna().all()  # nulls inside every window keep the full-window rule
    np.testing.assert_allclose(got["v"], want["v"].reset_index(drop=True), rtol=1e-9)
    loose = rolling(d, {"m": ("avg", "x", 40), "s": ("std", "x", 40)}, least=10).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    np.testing.assert_allclose(loose["s"], g["x"].transform(lambda s: s.rolling(40, min_periods=10).std()).reset_index(drop=True), rtol=1e-6)


def test_rolling_constant_series_has_zero_deviation(spark):
    d = spark.range(100).select(F.lit(1).alias("symbol"), F.col("id").alias("date"), F.lit(1234.567).alias("x"))
    assert rolling(d, {"s": ("std", "x", 30)}).filter("s <> 0").count() == 0


def test_rolling_pairs_shift(spark):
    d = panel(spark, 1).select("symbol", "date", F.col("close").alias("x"), F.col("volume").alias("y"))
    got = rolling_pairs(d, "x", "y", [30], shift=1).toPandas().sort_values("date").reset_index(drop=True)
    want = got["x"].rolling(30).cov(got["y"]).shift(1)
    np.testing.assert_allclose(got["_pair_cov_30"][30:], want[30:], rtol=1e-7)


@pytest.mark.parametrize("span", [3, 12, 100])
def test_ewma_adjusted(spark, span):
    d = panel(spark, 2, 700)
    got = ft.ewma(d, "close", span, "e").toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = got.groupby("symbol")["close"].transform(lambda s: s.ewm(span=span, adjust=True).mean())
    np.testing.assert_allclose(got["e"], want, rtol=1e-10)


def test_total_return_inverse(spark):
    d = spark.createDataFrame([("A", dt.date(2024, 1, i), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 1.0) for i in range(1, 5)], "symbol string, date date, open double, high double, low double, close double, volume double")
    div_ = spark.createDataFrame([("A", dt.date(2024, 1, 3), 0.5)], "symbol string, ex_date date, dividend_per_share double")
    rows = {r.date.day: r for r in ft.price_series(d, div_).collect()}
    assert rows[1].close_tr == rows[1].close and rows[2].close_tr == rows[2].close and rows[3].close_tr > rows[3].close
    assert abs(rows[3].close_tr / rows[3].close - (1 + 0.5 / rows[2].close)) < 1e-12


def test_cooldown_equals_loop(spark):
    n = 400
    pos = RNG.choice([-1.0, 0.0, 0.0, 0.0, 1.0], n)
    pos[100:130] = 0.0
    d = spark.createDataFrame(pd.DataFrame({"symbol": 1, "date": np.arange(n), "p": pos}))
    got = ps.cooldown(d, "p", 7).orderBy("date").toPandas()["cooled"].to_numpy()
    out, cur, last = [], 0.0, -7
    for i, v in enumerate(pos):
        if v == 0.0:
            cur = 0.0
        elif v != cur and i - last >= 7:
            cur, last = v, i
        out.append(cur)
    np.testing.assert_array_equal(got, out)


def test_triple_barrier_by_hand(spark):
    n = 60
    c = 100 * np.exp(np.cumsum(RNG.normal(0, 0.03, n)))
    d = spark.createDataFrame(pd.DataFrame({"symbol": 1, "date": np.arange(n), "close": c, "primary_position": RNG.choice([-1.0, 0.0, 1.0], n)}))
    got = sg.triple_barrier(d, vertical=6, vol_rows=10).orderBy("date").toPandas()
    lr = np.concatenate([[0.0], np.diff(np.log(c))])
    for t in range(n):
        side = np.sign(got["primary_position"][t])
        if side == 0 or t < 10:
            assert np.isnan(got["triple_barrier_label"][t])
            continue
        sd, path, want = np.std(lr[t - 10:t], ddof=1), np.cumsum(lr[t + 1:t + 7]) * side, 0.0
        for v in path:
            if v >= 1.5 * sd:
                want = 1.0
                break
            if v <= -1.5 * sd:
                break
        assert got["triple_barrier_label"][t] == want


def test_residual_state_machine(spark):
    z = [0.0, 2.0, 1.0, 0.4, -1.6, -1.0, -0.9, -0.8, None, 3.0]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(z)], "symbol int, date int, residual_z double")
    got = [r.position for r in sg.residual_state(d, entry=1.5, leave=0.5, max_days=3).orderBy("date").collect()]
    assert got == [0.0, -1.0, -1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, -1.0]


def test_calendar_and_null_policy(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 5), None), (dt.date(2024, 1, 6), 2.0), (dt.date(2024, 1, 8), -3.0)], "d date, x double")
    r = d.select(next_weekday("d").alias("n"), clip("x", 0.0).alias("c"), div(F.lit(1.0), F.lit(0.0)).alias("z")).collect()
    assert [x.n for x in r] == [dt.date(2024, 1, 8), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
    assert [x.c for x in r] == [None, 2.0, 0.0] and r[0].z is None
    with pytest.raises(ContractError):
        require_columns(d, ["y"])


def test_align_to_bar(spark):
    d = spark.sql("SELECT TIMESTAMP '2024-01-02 13:35:42' AS t UNION ALL SELECT TIMESTAMP '2024-01-02 13:35:00'")
    up = {str(r.a) for r in d.select(align_to_bar("t", 5).alias("a")).collect()}
    down = {str(r.a) for r in d.select(align_to_bar("t", 5, mode="floor").alias("a")).collect()}
    assert up == {"2024-01-02 13:41:00", "2024-01-02 13:40:00"} and down == {"2024-01-02 13:40:00"}


def test_normal_round_trip(spark):
    d = spark.range(1, 100).select((F.col("id") / 100).alias("p"))
    assert d.select(F.max(F.abs(norm_cdf(norm_ppf("p")) - F.col("p"))).alias("e")).first().e < 1e-12
