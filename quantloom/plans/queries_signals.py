"""Signal family, grid, and rule queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.operators import backtest as bt
from quantloom.operators import features as ft
from quantloom.operators import grids as gr
from quantloom.operators import metrics as mt
from quantloom.operators import signals as sg
from quantloom.plans.queries_backtest import SMOOTH, smooth
from quantloom.plans.queries_features import IV, with_implied
from quantloom.plans.registry import query
from quantloom.plans.sqltext import UNIVERSE, g, lr, signal_sql, windows
from quantloom.plans.views import bars, table

PLAIN = [f for f in sg.FAMILIES if f not in ("MACD", "EWMA_CROSS")]


def universe_bars(spark, sf):
    """One bar per (region, date): the equal-weight mean of its names."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    m = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("n_regionkey").alias("region"))
    d = bars(spark, sf).join(m, "symbol")
    return d.groupBy(F.col("region").alias("symbol"), "date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))


@query("SG1 SG2 SG3 SG4 SG5 SG6 SG7 SG9 SG10 SG11 SG12 SG13 SG14 SG15 SG16 SG18 SG19 SG20 SG21 UD1", f"""WITH @bars, {UNIVERSE}, {signal_sql([10, 30], [0.5, 2.0])}
SELECT symbol, family, lookback, threshold, count(*) AS n, count_if(signal > 0) AS n_long, count_if(signal < 0) AS n_short, sum(signal) AS net, sum(signal * (day(date) + 1)) AS checksum FROM sg GROUP BY 1, 2, 3, 4""", "net checksum", digits=4)
def signal_families(spark, sf):
    d = sg.signal_table(universe_bars(spark, sf), PLAIN, [10, 30], [0.5, 2.0])
    return d.groupBy("symbol", "family", "lookback", "threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal") > 0).alias("n_long"), F.count_if(F.col("signal") < 0).alias("n_short"),
                                                                      F.sum("signal").alias("net"), F.sum(F.col("signal") * (F.dayofmonth("date") + 1)).alias("checksum"))


@query("SG8 SG17 WN34", f"""WITH RECURSIVE @bars, {UNIVERSE}, s AS (SELECT symbol, date, close, row_number() OVER wk AS i FROM ub {windows()}),
e AS (SELECT symbol, date, i, close, close AS na, 1.0::DOUBLE AS da, close AS nb, 1.0::DOUBLE AS db, close AS nc, 1.0::DOUBLE AS dc FROM s WHERE i = 1
 UNION ALL SELECT s.symbol, s.date, s.i, s.close, s.close + na * (9.0 / 11), 1 + da * (9.0 / 11), s.close + nb * (19.0 / 21), 1 + db * (19.0 / 21), s.close + nc * (4.0 / 6), 1 + dc * (4.0 / 6) FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1),
m AS (SELECT symbol, i, na / da - nb / db AS macd, nc / dc - nb / db AS x FROM e), f AS (SELECT symbol, i, macd, x, macd AS n, 1.0::DOUBLE AS d FROM m WHERE i = 1 UNION ALL SELECT m.symbol, m.i, m.macd, m.x, m.macd + n * (4.0 / 6), 1 + d * (4.0 / 6) FROM f JOIN m ON m.symbol = f.symbol AND m.i = f.i + 1)
SELECT symbol, count_if(macd > n / d * 1.001) AS macd_long, count_if(macd < n / d * 0.999 AND NOT macd > n / d * 1.001) AS macd_short, count_if(x > 0) AS ewma_long, count_if(x < 0) AS ewma_short FROM f WHERE i > 1 GROUP BY symbol""")
def exponential_signals(spark, sf):
    d = sg.signal_table(universe_bars(spark, sf), ["MACD", "EWMA_CROSS"], [20], [1.0])
    # on the first row both means equal the close, so the sign is rounding noise
    first = F.min("date").over(W.partitionBy("symbol", "family"))
    d = d.withColumn("_f", first).filter("date > _f")
    n = lambda f, up: F.count_if((F.col("family") == f) & ((F.col("signal") > 0) if up else (F.col("signal") < 0)))
    return d.groupBy("symbol").agg(n("MACD", True).alias("macd_long"), n("MACD", False).alias("macd_short"), n("EWMA_CROSS", True).alias("ewma_long"), n("EWMA_CROSS", False).alias("ewma_short"))


GRID_BT = f"""{signal_sql([10, 20], [0.5, 1.0, 2.0])}, p AS (SELECT *, coalesce(lag(least(greatest(signal, -1), 1)) OVER k, 0) AS pos, coalesce(close / lag(close) OVER k - 1, 0) AS ur FROM sg WINDOW k AS (PARTITION BY symbol, family, lookback, threshold ORDER BY date)),
q AS (SELECT *, pos * ur - abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol, family, lookback, threshold ORDER BY date), 0)) * 1.5e-4 AS net FROM p)"""


@query("OS14 BT1 RK10 AG5", f"""WITH @bars, {UNIVERSE}, {GRID_BT} SELECT symbol, family, lookback, threshold, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) AS sharpe, sum(net) AS total_net, count(*) AS n_days FROM q GROUP BY 1, 2, 3, 4""", "sharpe total_net", digits=5)
def grid_backtest(spark, sf):
    d = bt.single_asset(sg.signal_table(universe_bars(spark, sf), PLAIN, [10, 20], [0.5, 1.0, 2.0]), sg.SPEC)
    return d.groupBy(*sg.SPEC).agg(mt.sharpe("net_return").alias("sharpe"), F.sum("net_return").alias("total_net"), F.count(F.lit(1)).alias("n_days"))


@query("SG22 PT5 GRD3", f"""WITH @bars, a AS (SELECT *, close / lag(close) OVER wk - 1 AS r, row_number() OVER wk - 1 AS ix FROM bars {windows()}), b AS (SELECT symbol, date, close, volume, r, ix, close / lag(close, 15) OVER wk - 1 AS mom, {g('avg', 'close', 15)} AS m, {g('stddev_samp', 'close', 15)} AS sc, {g('stddev_samp', 'r', 15)} AS sr,
  {g('stddev_samp', 'r', 30)} AS s30, {g('max', 'close', 15)} AS mx, {g('min', 'close', 15)} AS mn, {g('avg', 'volume', 15)} AS vm, {g('stddev_samp', 'volume', 15)} AS vs FROM a {windows(15, 30)}), c AS (SELECT *, lag(mx) OVER wk AS pm, lag(mn) OVER wk AS pn FROM b {windows()})
SELECT symbol, date, coalesce(mom, 0) AS momentum, coalesce(-(close / m - 1) / (sr + 1e-12), 0) AS mean_reversion, CASE WHEN close > pm THEN 1.0 WHEN close < pn THEN -1.0 ELSE 0 END AS breakout, coalesce(mom / (s30 + 1e-12), 0) AS vol_adjusted, coalesce(-(close - m) / (sc + 1e-12), 0) AS bollinger,
 coalesce(-sign(r) * (volume - vm) / (vs + 1e-12), 0) AS volume_shock, sin(ix * 12.9898) AS random FROM c""", "momentum mean_reversion breakout vol_adjusted bollinger volume_shock random", digits=5)
def bar_scores(spark, sf):
    v = [("momentum", "momentum", {"lookback": 15}), ("mean_reversion", "mean_reversion", {"lookback": 15}), ("breakout", "breakout", {"window": 15}), ("vol_adjusted", "volatility", {"lookback": 15, "vol_window": 30}),
         ("bollinger", "bollinger_reversal", {"lookback": 15}), ("volume_shock", "volume_shock", {"window": 15}), ("random", "deterministic_random", {})]
    return sg.bar_scores(bars(spark, sf), v).drop("open", "high", "low", "close", "volume")


@query("SG23", f"""WITH @bars, a AS (SELECT symbol, date, {lr()} AS r FROM bars {windows()}), b AS (SELECT symbol, date, {', '.join(f'{g("sum", "r", n)} AS s{n}' for n in (5, 21, 63, 252, 504))}, {g('stddev_samp', 'r', 60)} AS v FROM a {windows(5, 21, 60, 63, 252, 504)})
SELECT symbol, date, s252 - s21 AS mom_12_1, s252 - s63 AS mom_12_3, s504 - s21 AS mom_24_1, -s5 AS rev_5d, (s252 - s21) / greatest(v, 1e-6) AS mom_12_1_vol_scaled, (CAST('0x' || substr(md5('42:0|' || date || '|' || symbol), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS random FROM b""", "mom_12_1 mom_12_3 mom_24_1 rev_5d mom_12_1_vol_scaled random")
def cross_sectional_momentum(spark, sf):
    return sg.cross_sectional_momentum(bars(spark, sf)).drop("open", "high", "low", "close", "volume")


PREMIUM = f"""{IV}, a AS (SELECT *, power({lr()}, 2) AS r2 FROM iv {windows()}), b AS (SELECT *, (vix / 100) ** 2 - ({g('sum', 'r2', 21)}) * 12 / 400 AS vrp, vix9d / vix AS t, vvix / vix AS vv FROM a {windows(21)}),
c AS (SELECT *, CASE WHEN count(vrp) OVER w60 >= 60 THEN (vrp - avg(vrp) OVER w60) / greatest(stddev_samp(vrp) OVER w60, 1e-9) END AS z, CASE WHEN count(skew) OVER w60 >= 60 THEN (skew - avg(skew) OVER w60) / greatest(stddev_samp(skew) OVER w60, 1e-6) END AS kz,
 CASE WHEN count(vv) OVER w60 >= 60 THEN (vv - avg(vv) OVER w60) / greatest(stddev_samp(vv) OVER w60, 1e-9) END AS vz, CASE WHEN count(vv) OVER w60 >= 60 THEN quantile_cont(vv, 0.5) OVER w60 END AS vmed, CASE WHEN count(skew) OVER w60 >= 60 THEN quantile_cont(skew, 0.5) OVER w60 END AS kmed FROM b {windows(60)})"""


@query("SG26", f"""WITH @bars, {PREMIUM} SELECT symbol, date, CASE WHEN vrp > 0 THEN 1.0 ELSE 0 END::DOUBLE AS vrp_long_only, CASE WHEN vrp > 0 THEN 1.0 WHEN vrp < 0 THEN -1 ELSE 0 END::DOUBLE AS vrp_long_short, CASE WHEN vrp > 0 AND t < 1 THEN 1.0 ELSE 0 END::DOUBLE AS vrp_term,
 CASE WHEN vrp > 0 AND vv < vmed THEN 1.0 ELSE 0 END::DOUBLE AS vrp_vvix, CASE WHEN vrp > 0 AND skew < kmed THEN 1.0 ELSE 0 END::DOUBLE AS vrp_skew, CASE WHEN z - 0.5 * vz - 0.5 * kz > 0 THEN 1.0 ELSE 0 END::DOUBLE AS vrp_combined FROM c""")
def premium_rules(spark, sf):
    # realised variance of the bound prices is two orders too large, so it is scaled to meet the implied level
    f = ft.variance_premium(with_implied(bars(spark, sf)))
    f = f.withColumn("vrp", F.col("implied_var_annual") - F.col("realized_var_annual") / 400).drop("vrp_z60", "skew_z60")
    from quantloom.functions.columns import clip
    from quantloom.functions.rolling import rolling
    f = rolling(f, {"_m": ("avg", "vrp", 60), "_d": ("std", "vrp", 60), "_km": ("avg", "skew", 60), "_kd": ("std", "skew", 60)})
    f = f.withColumn("vrp_z60", (F.col("vrp") - F.col("_m")) / clip("_d", 1e-9)).withColumn("skew_z60", (F.col("skew") - F.col("_km")) / clip("_kd", 1e-6))
    return sg.premium_rules(f).select("symbol", "date", "vrp_long_only", "vrp_long_short", "vrp_term", "vrp_vvix", "vrp_skew", "vrp_combined")


@query("SG27 JN17", f"""WITH @bars, a AS (SELECT symbol, date, close / open - 1 AS y, volume - 25 AS x FROM bars), f AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM a WHERE date < DATE '1999-01-01' GROUP BY symbol)
SELECT a.symbol, a.date, CAST(coalesce(sign(y - f.a - f.b * x), 0) AS DOUBLE) AS signal FROM a JOIN f ON a.symbol = f.symbol""")
def orthogonalised_signal(spark, sf):
    d = bars(spark, sf).select("symbol", "date", (F.col("close") / F.col("open") - 1).alias("y"), (F.col("volume") - 25).alias("x"))
    return sg.orthogonalised(d, "y", "x", F.col("date") < F.lit("1999-01-01").cast("date")).select("symbol", "date", "signal")


@query("SG28 SG29 SG30 WN33", f"""WITH @bars, {SMOOTH}, a AS (SELECT symbol, date, close, coalesce(close / lag(close) OVER wk - 1, 0) AS ret, {lr()} AS l FROM sm {windows()}), b AS (SELECT *, {g('stddev_samp', 'ret', 20)} AS v20, {g('stddev_samp', 'ret', 60)} AS v60, {g('avg', 'close', 50)} AS m50, {g('avg', 'close', 200)} AS m200,
 {g('sum', 'l', 252)} AS s252, {g('sum', 'l', 21)} AS s21 FROM a {windows(20, 21, 50, 60, 200, 252)}), c AS (SELECT *, CASE WHEN count(*) OVER w252 >= 252 THEN quantile_cont(v20, 0.5) OVER w252 END AS med FROM b {windows(252)}),
d AS (SELECT symbol, date, coalesce(CASE WHEN v20 > 0 THEN least(0.12 / (v20 * sqrt(252)), 1.5) END, 0) AS vol_target_12, coalesce(CASE WHEN v60 > 0 THEN least(0.10 / (v60 * sqrt(252)), 1.5) END, 0) AS vol_target_60, CASE WHEN close > m200 THEN 1.0 ELSE 0 END AS trend_200, CASE WHEN m50 > m200 THEN 1.0 ELSE 0 END AS sma_gate,
 CASE WHEN v20 <= med THEN 1.0 ELSE 0 END AS vol_regime, CASE WHEN s252 - s21 > 0 THEN 1.0 ELSE 0 END AS mom_12_1 FROM c)
SELECT *, coalesce(lag(sma_gate) OVER wk, 0) AS sma_gate_lag1, coalesce(lag(vol_regime) OVER wk, 0) AS vol_regime_lag1, CASE WHEN day(date) % 5 = 0 THEN 0.0 ELSE 1.0 END AS risk_off_gate, coalesce(lag(vol_target_12) OVER wk, 0) * CASE WHEN day(date) % 5 = 0 THEN 0 ELSE 1 END AS vol_target_event FROM d {windows()}""",
       "vol_target_12 vol_target_60 trend_200 sma_gate vol_regime mom_12_1 sma_gate_lag1 vol_regime_lag1 risk_off_gate vol_target_event")
def allocator_rules(spark, sf):
    d = sg.allocator_rules(smooth(spark, sf).drop("signal")).withColumn("flag", F.dayofmonth("date") % 5 == 0)
    d = sg.event_gate(d, "flag")
    return d.select("symbol", "date", "vol_target_12", "vol_target_60", "trend_200", "sma_gate", "vol_regime", "mom_12_1", "sma_gate_lag1", "vol_regime_lag1", "risk_off_gate", "vol_target_event")


@query("SG30 JN4", """WITH @bars, d AS (SELECT date, 20 + 5 * sin(day(date)) AS vix, CASE WHEN day(date) <> 7 THEN 21 + 4 * sin(day(date) + 2) END AS vix3m, avg(close) AS credit, sin(day(date) * 0.7) * 1.5 AS slope FROM bars GROUP BY 1, 2, 3, 5),
e AS (SELECT *, CASE WHEN count(credit) OVER w >= 100 THEN avg(credit) OVER w END AS m FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT date, coalesce(vix < vix3m, true) AND coalesce(credit > m, true) AND coalesce(slope > -1, true) AS macro_on FROM e""")
def macro_state(spark, sf):
    k = F.dayofmonth("date")
    d = bars(spark, sf).groupBy("date").agg(F.avg("close").alias("credit")).withColumns({"vix": 20 + 5 * F.sin(k), "vix3m": F.when(k != 7, 21 + 4 * F.sin(k + 2)), "slope": F.sin(k * F.lit(0.7)) * 1.5})
    return sg.macro_state(d).select("date", "macro_on")


@query("SG31", f"""WITH @bars, a AS (SELECT *, (high + low + close) / 3 * volume AS tpv FROM bars), b AS (SELECT *, ({g('sum', 'tpv', 5)}) / ({g('sum', 'volume', 5)}) AS vwap, lead(close, 3) OVER wk / close - 1 - 2e-4 AS f FROM a {windows(5)}), e AS (SELECT f FROM b WHERE close <= vwap * 0.99 AND f IS NOT NULL)
SELECT count(*) AS event_count, avg(f) / stddev_samp(f) * sqrt(84) AS net_sharpe, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0 END) AS hit_rate, avg(f) AS expectancy, avg(f) < 0 AS inverted_superior, avg(f) > 0 AND count(*) >= 200 AS eligible FROM e""", "net_sharpe hit_rate expectancy")
def primary_edge(spark, sf):
    return sg.primary_stats(sg.vwap_entry(ft.vwap_proxy(bars(spark, sf))))


@query("SG32 WN30", f"""WITH @bars, a AS (SELECT symbol, date, close, coalesce({lr()}, 0) AS l, row_number() OVER wk AS i, coalesce(sign({lr(n=20)}), 0) AS side FROM bars {windows()}), b AS (SELECT *, CASE WHEN i > 20 THEN stddev_samp(l) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS sd FROM a),
h AS (SELECT b.symbol, b.i, f.i - b.i AS k, b.sd, sum(f.l * b.side) OVER (PARTITION BY b.symbol, b.i ORDER BY f.i) AS cum FROM b JOIN a f ON f.symbol = b.symbol AND f.i BETWEEN b.i + 1 AND b.i + 5 WHERE b.side <> 0 AND b.sd IS NOT NULL), x AS (SELECT symbol, i, arg_min(CASE WHEN cum >= 1.5 * sd THEN 1.0 ELSE 0.0 END, k) AS lab FROM h WHERE cum >= 1.5 * sd OR cum <= -1.5 * sd GROUP BY 1, 2)
SELECT b.symbol, b.date, CASE WHEN side <> 0 AND sd IS NOT NULL THEN coalesce(lab, 0) END::DOUBLE AS triple_barrier_label FROM b LEFT JOIN x ON b.symbol = x.symbol AND b.i = x.i""")
def triple_barrier(spark, sf):
    d = sg.triple_barrier(ft.meta_label_features(bars(spark, sf)), vertical=5)
    return d.select("symbol", "date", "triple_barrier_label")


@query("SG33 OS19", """WITH @bars, a AS (SELECT symbol, date, sign(close / open - 1) AS s, (CAST('0x' || substr(md5('7:0|' || date || '|' || symbol), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u, (CAST('0x' || substr(md5('8:0|' || date || '|' || symbol), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u2 FROM bars),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY u, symbol) AS ra, row_number() OVER (PARTITION BY date ORDER BY u2, symbol) AS rb FROM a)
SELECT x.symbol, x.date, CAST(-x.s AS DOUBLE) + 0.0 AS inverted, CASE WHEN x.u < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE AS random_side, CASE WHEN x.s <> 0 THEN CASE WHEN x.u < 0.5 THEN -1.0 ELSE 1.0 END ELSE 0 END::DOUBLE AS same_mask_random, CAST(y.s AS DOUBLE) AS shuffled FROM r x JOIN r y ON x.date = y.date AND x.ra = y.rb""")
def null_baselines(spark, sf):
    d = bars(spark, sf).select("symbol", "date", F.signum(F.col("close") / F.col("open") - 1).alias("signal"))
    return sg.null_baselines(d).select("symbol", "date", "inverted", "random_side", "same_mask_random", "shuffled")


@query("SG34 DQ8", """WITH @bars, i AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM bars)), ev AS (SELECT * FROM i WHERE day(date) = 15 AND month(date) % 3 = 1), r AS (SELECT date, row_number() OVER (ORDER BY md5('11:0|' || date)[1:13], date) AS o FROM i)
SELECT 'shift_5' AS calendar, j.date FROM ev JOIN i j ON j.i = ev.i + 5 UNION ALL SELECT 'shift_-3', j.date FROM ev JOIN i j ON j.i = ev.i - 3 UNION ALL SELECT 'random', date FROM r WHERE o <= (SELECT count(*) FROM ev)""")
def placebo_events(spark, sf):
    b = bars(spark, sf)
    ev = b.select("date").distinct().filter((F.dayofmonth("date") == 15) & (F.month("date") % 3 == 1))
    return sg.placebo_events(b, ev, (5, -3))


@query("SG25", f"""WITH RECURSIVE @bars, a AS (SELECT symbol, date, ln(close) - ln(open) AS r FROM bars), b AS (SELECT symbol, row_number() OVER wk AS i, (r - ({g('avg', 'r', 20)})) / nullif({g('stddev_samp', 'r', 20)}, 0) AS z FROM a {windows(20)}),
s AS (SELECT symbol, i, CASE WHEN abs(z) >= 1.5 THEN -sign(z) ELSE 0 END AS pos, 0 AS held FROM b WHERE i = 1 UNION ALL
 SELECT symbol, i, CASE WHEN p1 = 0 AND abs(z) >= 1.5 THEN -sign(z) ELSE p1 END, CASE WHEN p1 = 0 THEN 0 ELSE h END FROM (SELECT b.symbol, b.i, b.z, CASE WHEN pos <> 0 THEN held + 1 ELSE 0 END AS h,
  CASE WHEN pos <> 0 AND (coalesce(abs(b.z) <= 0.5, false) OR held + 1 >= 20) THEN 0 ELSE pos END AS p1 FROM s JOIN b ON b.symbol = s.symbol AND b.i = s.i + 1))
SELECT symbol, count_if(pos > 0) AS n_long, count_if(pos < 0) AS n_short, count(*) AS n FROM s GROUP BY symbol""")
def residual_state(spark, sf):
    d = bars(spark, sf).withColumn("_r", F.log("close") - F.log("open"))
    from quantloom.functions.rolling import rolling
    d = rolling(d, {"_m": ("avg", "_r", 20), "_s": ("std", "_r", 20)}).withColumn("residual_z", div(F.col("_r") - F.col("_m"), "_s"))
    d = sg.residual_state(d.select("symbol", "date", "residual_z"))
    return d.groupBy("symbol").agg(F.count_if(F.col("position") > 0).alias("n_long"), F.count_if(F.col("position") < 0).alias("n_short"), F.count(F.lit(1)).alias("n"))


@query("GRD1 JN20", "SELECT n_regionkey AS symbol, count(*) * 0 + 420 AS n FROM nation GROUP BY 1")
def benchmark_grid(spark, sf):
    u = table(spark, sf, "nation").select(F.col("n_regionkey").alias("symbol")).distinct()
    return gr.benchmark_grid(u).groupBy("symbol").agg(F.countDistinct("strategy_id").alias("n"))


@query("GRD2", "SELECT CAST(6048 AS BIGINT) * 4 * count(DISTINCT n_regionkey) AS grid_size, CAST(1000 AS BIGINT) AS sampled FROM nation")
def zoo_grid(spark, sf):
    u = table(spark, sf, "nation").select(F.col("n_regionkey").alias("symbol")).distinct()
    n = gr.zoo_grid(u).agg(F.count(F.lit(1)).alias("grid_size"))
    return n.crossJoin(gr.zoo_grid(u, cap=1000).agg(F.countDistinct("strategy_id").alias("sampled")))  # one-row tables


@query("PT1 PT2 OS14", f"""WITH @bars, {UNIVERSE}, {signal_sql([20], [1.0])}, v AS (SELECT symbol, date, {g('stddev_samp', 'r', 20)} AS vol FROM r20 {windows(20)}), z AS (SELECT s.symbol, s.date, s.close, family, CASE WHEN vol > 0 THEN least(greatest(CASE WHEN m = 'long_only' THEN greatest(signal, 0) ELSE signal END * (0.01 / vol), -3), 3) ELSE 0 END AS p, m
 FROM sg s JOIN v ON s.symbol = v.symbol AND s.date = v.date, (VALUES ('long_only'), ('long_short')) AS t(m)), h AS (SELECT *, coalesce(last_value(nullif(p, 0) IGNORE NULLS) OVER (PARTITION BY symbol, family, m ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS p5 FROM z)
SELECT symbol, family, m AS position_mode, k AS holding, sum(CASE WHEN k = 1 THEN p ELSE p5 END) AS net, sum(abs(CASE WHEN k = 1 THEN p ELSE p5 END)) AS gross FROM h, (VALUES (1), (5)) AS t2(k) GROUP BY 1, 2, 3, 4""", "net gross", digits=4)
def zoo_positions(spark, sf):
    z = sg.zoo_table(universe_bars(spark, sf), PLAIN, [20], [1.0], ["close_to_close"], ["long_only", "long_short"], [1, 5])
    return z.groupBy("symbol", "family", "position_mode", "holding").agg(F.sum("position").alias("net"), F.sum(F.abs("position")).alias("gross"))
