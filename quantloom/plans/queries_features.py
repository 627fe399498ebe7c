"""Feature, label and rank queries over the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by, clip, div, logret
from quantloom.operators import features as ft
from quantloom.operators import ranks as rk
from quantloom.plans.registry import query
from quantloom.plans.sqltext import SOFAR, g, lr, prior, windows
from quantloom.plans.views import bars, by_symbol, daily, dividends, membership
from quantloom.session import by_key

R1 = f"r AS (SELECT *, {lr()} AS r1 FROM bars WINDOW wk AS (PARTITION BY symbol ORDER BY date))"


def rank_sql(x: str, rel: str, q: float) -> str:
    return f"""SELECT date, n_rows, top_return, bottom_return, top_return - bottom_return AS spread FROM (
  SELECT date, count(*) AS n_rows, avg(CASE WHEN rk > cnt - n THEN y END) AS top_return, avg(CASE WHEN rk <= n THEN y END) AS bottom_return
  FROM (SELECT *, least(greatest(CAST(floor(cnt * {q}) AS BIGINT), 1), cnt // 2) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY {x}, symbol) AS rk, count(*) OVER (PARTITION BY date) AS cnt FROM {rel}))
  WHERE cnt >= 2 GROUP BY date)"""


@query("WN1 WN4 RK1 RK6 MT1", f"""WITH @bars, {R1},
v AS (SELECT symbol, date, {g('stddev_samp', 'r1', 20)} AS vol, lead(close) OVER wk / close - 1 AS y FROM r {windows(20)}),
ok AS (SELECT * FROM v WHERE vol IS NOT NULL AND y IS NOT NULL),
d AS ({rank_sql('vol', 'ok', 0.2)})
SELECT date, n_rows, top_return, bottom_return, spread,
  sqrt(252) * avg(spread) OVER () / stddev_samp(spread) OVER () AS sharpe FROM d""", "top_return bottom_return spread sharpe")
def flagship_rank_spread(spark, sf):
    d = ft.volatility(bars(spark, sf), windows=(20,)).withColumn("y", div(F.lead("close", 1).over(by()), "close") - 1.0)
    d = d.select("symbol", "date", F.col("realized_vol_20").alias("vol"), "y").filter("vol IS NOT NULL AND y IS NOT NULL")
    daily = rk.top_bottom_by_date(d, "vol", "y", 0.2)
    total = daily.agg((F.sqrt(F.lit(252.0)) * div(F.avg("spread"), F.stddev_samp("spread"))).alias("sharpe"))
    return daily.crossJoin(F.broadcast(total))  # one row


@query("WN1 FN1", f"""WITH @bars SELECT symbol, date, {', '.join(f'{lr(n=h)} AS log_return_{h}' for h in (1, 2, 5, 10, 20, 60, 120, 252))},
{', '.join(f'ln(lag(close, 5) OVER wk) - ln(lag(close, {h}) OVER wk) AS cumulative_return_{h}_skip5' for h in (60, 120, 252))},
-({lr(n=5)}) AS mean_reversion_5 FROM bars WINDOW wk AS (PARTITION BY symbol ORDER BY date)""",
       " ".join(f"log_return_{h}" for h in (1, 2, 5, 10, 20, 60, 120, 252)) + " mean_reversion_5 "
       + " ".join(f"cumulative_return_{h}_skip5" for h in (60, 120, 252)))
def returns_momentum(spark, sf):
    return ft.returns_momentum(bars(spark, sf)).drop("open", "high", "low", "close", "volume")


@query("WN2 WN3", f"""WITH @bars SELECT symbol, date, lag(close, 1) OVER wk AS close_lag1, lag(close, 5) OVER wk AS close_lag5,
lag(volume, 1) OVER wk AS volume_lag1, lag(volume, 5) OVER wk AS volume_lag5,
{', '.join(f'{g("avg", c, n)} AS {c}_mean{n}, {g("stddev_samp", c, n)} AS {c}_std{n}' for c in ('close', 'volume') for n in (5, 20))}
FROM bars {windows(5, 20)}""", "close_lag1 close_lag5 volume_lag1 volume_lag5 " + " ".join(f"{c}_{s}{n}" for c in ("close", "volume") for s in ("mean", "std") for n in (5, 20)), digits=5)
def lag_and_rolling(spark, sf):
    d = ft.rolling_features(ft.lag_features(bars(spark, sf), ["close", "volume"], [1, 5]), ["close", "volume"], [5, 20])
    return d.drop("open", "high", "low", "close", "volume")


@query("WN4 WN5 WN6 WN7", f"""WITH @bars, r AS (SELECT *, {lr()} AS r1, ln(high / low) ** 2 AS hl2,
  greatest(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2, 0) AS gk FROM bars WINDOW wk AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT symbol, date, {', '.join(f'{g("stddev_samp", "r1", n)} AS realized_vol_{n}' for n in (5, 20, 60))},
  sqrt(({g('avg', 'hl2', 20)}) / (4 * ln(2))) AS parkinson_vol_20, sqrt({g('avg', 'gk', 20)}) AS garman_klass_vol_20 FROM r {windows(5, 20, 60)})
SELECT *, {g('stddev_samp', 'realized_vol_20', 60)} AS vol_of_vol_60 FROM v {windows(60)}""",
       "realized_vol_5 realized_vol_20 realized_vol_60 parkinson_vol_20 garman_klass_vol_20 vol_of_vol_60")
def volatility_pack(spark, sf):
    return ft.volatility(bars(spark, sf)).drop("open", "high", "low", "close", "volume")


@query("WN8", f"""WITH @bars, r AS (SELECT *, {lr()} AS r1, (ln(high) - ln(low)) ** 2 AS hl2,
  (ln(high) - ln(close)) * (ln(high) - ln(open)) + (ln(low) - ln(close)) * (ln(low) - ln(open)) AS rs FROM bars WINDOW wk AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, {g('stddev_samp', 'r1', 20)} AS close_to_close, sqrt(({g('avg', 'hl2', 20)}) / (4 * ln(2))) AS parkinson,
  CASE WHEN count(rs) OVER w20 >= 20 THEN sqrt(greatest(avg(rs) OVER w20, 0)) END AS rogers_satchell FROM r {windows(20)}""",
       "close_to_close parkinson rogers_satchell")
def vol_estimators(spark, sf):
    d = bars(spark, sf)
    for e in ("close_to_close", "parkinson", "rogers_satchell"):
        d = ft.rolling_vol(d, 20, e, e)
    return d.drop("open", "high", "low", "close", "volume")


@query("WN9 WN10 WN11 WN12", f"""WITH @bars, a AS (SELECT *, {lr()} AS r, close * volume AS dv FROM bars WINDOW wk AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, lag(r) OVER wk AS rl, abs(r) / greatest(dv, 1e-9) AS ill, sign(r) * dv AS s, abs(r) AS ar FROM a WINDOW wk AS (PARTITION BY symbol ORDER BY date)),
c AS (SELECT *, r * rl AS xy, ar * s AS ars FROM b),
d AS (SELECT *, {g('avg', 'xy', 20)} AS exy, {g('avg', 'r', 20)} AS ex, {g('avg', 'rl', 20)} AS ey, {g('avg', 'ars', 20)} AS eas, {g('avg', 'ar', 20)} AS ea,
  {g('avg', 's', 20)} AS es, {g('var_samp', 's', 20)} AS vs, {g('avg', 'ill', 20)} AS am, {g('max', 'high', 20)} AS hi, {g('min', 'low', 20)} AS lo,
  lag(close) OVER wk AS pc FROM c {windows(20)})
SELECT symbol, date, am * 1e6 AS amihud_illiq_20, CASE WHEN exy - ex * ey < 0 THEN 2 * sqrt(-(exy - ex * ey)) END AS roll_spread_20,
  (eas - ea * es) / greatest(vs, 1e-18) * 1e6 AS kyle_proxy_signed_volume_20, ln(open / pc) AS overnight_gap, ln(close / open) AS intraday_return,
  (close - lo) / greatest(hi - lo, 1e-9) AS close_location_20 FROM d""",
       "amihud_illiq_20 roll_spread_20 kyle_proxy_signed_volume_20 overnight_gap intraday_return close_location_20")
def microstructure_pack(spark, sf):
    d = ft.microstructure(bars(spark, sf))
    d = d.withColumn("amihud_illiq_20", F.col("amihud_illiq_20") * 1e6)  # scaled up so that rounding keeps digits
    d = d.withColumn("kyle_proxy_signed_volume_20", F.col("kyle_proxy_signed_volume_20") * 1e6)
    return d.drop("open", "high", "low", "close", "volume")


@query("WN13 WN14", f"""WITH @bars, a AS (SELECT *, close * volume AS dollar_volume FROM bars), b AS (SELECT *, ln(dollar_volume + 1) AS l FROM a),
c AS (SELECT symbol, date, dollar_volume, {g('avg', 'l', 20)} AS log_dollar_volume_20d,
  (volume - ({g('avg', 'volume', 20)})) / greatest({g('stddev_samp', 'volume', 20)}, 1e-9) AS z, count(volume) OVER w20 AS k, {g('median', 'dollar_volume', 20)} AS med
  FROM b {windows(20)})
SELECT symbol, date, dollar_volume, log_dollar_volume_20d, CASE WHEN k >= 20 THEN z END AS volume_zscore_20d, lag(med) OVER wk AS adv_20d_dollar_lag1 FROM c {windows()}""",
       "dollar_volume log_dollar_volume_20d volume_zscore_20d adv_20d_dollar_lag1", digits=4)
def liquidity_pack(spark, sf):
    return ft.lagged_adv(ft.volume_liquidity(bars(spark, sf))).drop("open", "high", "low", "close", "volume")


@query("WN15 JN2 AG8", f"""WITH @bars, {R1}, d AS (SELECT date, stddev_samp(r1) AS cross_sectional_dispersion, avg(r1) AS market_ret FROM r GROUP BY date),
e AS (SELECT *, {g('avg', 'cross_sectional_dispersion', 20)} AS cross_sectional_vol_20 FROM d {windows(20, key='')}),
ix AS (SELECT date, sum(close * volume) / sum(volume) AS c FROM bars GROUP BY date),
iy AS (SELECT date, ln(c) - ln(lag(c) OVER wk) AS ir, ln(c) - ln(lag(c, 5) OVER wk) AS index_log_return_5 FROM ix {windows(key='')}),
iz AS (SELECT date, index_log_return_5, {g('stddev_samp', 'ir', 20)} AS index_realized_vol_20 FROM iy {windows(20, key='')})
SELECT symbol, date, cross_sectional_dispersion, cross_sectional_vol_20,
  CASE WHEN day(date) % 2 = 0 THEN 15.0 + day(date) ELSE cross_sectional_vol_20 END AS vix_close, day(date) % 2 <> 0 AS vix_is_proxy, index_log_return_5, index_realized_vol_20
FROM bars JOIN e USING (date) JOIN iz USING (date)""", "cross_sectional_dispersion cross_sectional_vol_20 vix_close index_log_return_5 index_realized_vol_20")
def market_regime(spark, sf):
    b = bars(spark, sf)
    vix = b.select("date").distinct().filter(F.dayofmonth("date") % 2 == 0).withColumn("vix_close", 15.0 + F.dayofmonth("date"))
    ix = b.groupBy("date").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("index_close"))
    return ft.market_regime(b, vix, ix).drop("open", "high", "low", "close", "volume")


@query("WN16 WN39 JN1 WN38", f"""WITH @bars, @dividends, {R1},
j AS (SELECT r.*, coalesce(dividend_per_share, 0) AS dv, lag(close) OVER wk AS pc, {g('stddev_samp', 'r1', 20)} AS vol
  FROM r LEFT JOIN dividends d ON r.symbol = d.symbol AND r.date = d.ex_date WINDOW wk AS (PARTITION BY r.symbol ORDER BY date),
  w20 AS (PARTITION BY r.symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, close * product(CASE WHEN pc > 0 THEN 1 + dv / pc ELSE 1 END) OVER {SOFAR} AS close_tr, symbol % 3 <> 0 AS in_index FROM j),
y AS (SELECT *, lead(close_tr) OVER (PARTITION BY symbol ORDER BY date) / close_tr - 1 AS y_raw FROM t),
z AS (SELECT *, y_raw / greatest(vol, 1e-9) AS y_vn0 FROM y), q AS (SELECT *, CASE WHEN vol IS NOT NULL THEN y_vn0 END AS y_vn FROM z)
SELECT symbol, date, close_tr, y_raw, y_vn, CASE WHEN in_index THEN y_vn - avg(CASE WHEN in_index THEN y_vn END) OVER (PARTITION BY date) END AS y_xs FROM q""",
       "close_tr y_raw y_vn y_xs", digits=4)
def total_return_labels(spark, sf):
    b = bars(spark, sf)
    d = ft.price_series(b, dividends(spark, sf))
    d = ft.volatility(d, windows=(20,)).withColumn("in_index", F.col("symbol") % 3 != 0)
    return ft.forward_labels(d, "close_tr", "realized_vol_20", "in_index").select("symbol", "date", "close_tr", "y_raw", "y_vn", "y_xs")


@query("WN39 WN40", """WITH @bars, @dividends, j AS (SELECT b.symbol, b.date, close, coalesce(dividend_per_share, 0) AS dv, lag(close) OVER (PARTITION BY b.symbol ORDER BY date) AS pc
  FROM bars b LEFT JOIN dividends d ON b.symbol = d.symbol AND b.date = d.ex_date)
SELECT symbol, date, true AS round_trip_ok, close / pc - 1 AS price_return, (close + dv) / pc - 1 AS total_return FROM j""",
       "price_return total_return")
def dividend_round_trip(spark, sf):
    b, dv = bars(spark, sf), dividends(spark, sf)
    # reinvest and take out again with the tradable close as the reference of the factor
    tr = ft.total_return(b, dv).select("symbol", "date", F.col("close").alias("_tr"))
    factor = ft.total_return(b.withColumn("open", F.lit(1.0)), dv).select("symbol", "date", F.col("open").alias("_f"))
    d = ft.dividend_returns(b, dv).join(tr, ["symbol", "date"]).join(factor, ["symbol", "date"])
    return d.select("symbol", "date", (F.abs(F.col("_tr") / F.col("_f") - F.col("close")) < F.col("close") * 1e-9).alias("round_trip_ok"), "price_return", "total_return")


@query("WN17 WN18 PRJ1", f"""WITH @bars, a AS (SELECT symbol, date, close / lag(close) OVER wk - 1 AS return_1, open / lag(close) OVER wk - 1 AS gap_return_1, close / open - 1 AS open_close_return,
  {lr()} AS log_return_1, (high - low) / close AS high_low_range, volume / lag(volume) OVER wk - 1 AS volume_change_1,
  {', '.join(f'lead(close, {h}) OVER wk / close - 1 AS future_return_{h}' for h in (1, 5, 20))} FROM bars {windows()})
SELECT *, {', '.join(f'CAST(future_return_{h} > 0 AS TINYINT) AS direction_up_{h}' for h in (1, 5, 20))},
{', '.join(f'{g("stddev_samp", "log_return_1", n, max(2, min(n, 5)))} AS realized_vol_{n}, {g("avg", "return_1", n, max(2, min(n, 5)))} AS return_{n}_mean' for n in (5, 20, 60))}
FROM a {windows(5, 20, 60)}""", "return_1 gap_return_1 open_close_return log_return_1 high_low_range volume_change_1 future_return_1 future_return_5 future_return_20 "
       + " ".join(f"realized_vol_{n} return_{n}_mean" for n in (5, 20, 60)))
def past_only_features(spark, sf):
    from quantloom.sources.market import normalise_ohlcv
    b = bars(spark, sf).withColumn("date", F.concat(F.col("date").cast("string"), F.lit(" 00:00:00"))).withColumn("symbol", F.col("symbol").cast("string"))
    d = normalise_ohlcv(b, "bars", "date", "symbol").withColumn("symbol", F.col("symbol").cast("long"))
    d = by_key(d, d, "symbol")  # the cast symbol is a new key to the planner
    d = ft.past_only_ohlcv(d, horizons=(1, 5, 20))
    return d.drop("dataset_id", "open", "high", "low", "close", "volume", "dollar_volume")


@query("WN19", f"""WITH @bars, a AS (SELECT *, (high + low + close) / 3 AS vwap FROM bars), b AS (SELECT symbol, date,
  {', '.join(f'close / lag(close, {n}) OVER wk - 1 AS ret{n}' for n in (1, 5, 15, 60))}, close / vwap - 1 AS vwap_dev, ln(1 + volume) AS log_volume,
  lead(close, 15) OVER wk / close - 1 AS future_return FROM a {windows()})
SELECT *, {g('stddev_samp', 'ret1', 15)} AS vol15, {g('stddev_samp', 'ret1', 60)} AS vol60 FROM b {windows(15, 60)}""",
       "ret1 ret5 ret15 ret60 vwap_dev log_volume future_return vol15 vol60")
def minute_bar_features(spark, sf):
    b = bars(spark, sf).withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3.0).withColumn("count", F.lit(1))
    return ft.minute_features(b).drop("open", "high", "low", "close", "volume", "count", "vwap", "log_count")


@query("WN24 WN25 AG8", f"""WITH @bars, a AS (SELECT *, {lr()} AS r, close * volume AS dv, (close - low) / greatest(high - low, 1e-9) AS loc, row_number() OVER wk AS i FROM bars {windows()}),
b AS (SELECT *, abs(r) / dv AS ill, CASE WHEN r IS NOT NULL THEN avg(r) OVER (PARTITION BY date) END AS m FROM a),
c AS (SELECT symbol, date, {', '.join(f'{g("sum", "r", n)} AS s{n}' for n in (5, 21, 63, 126, 252))}, r AS reversal_1d, {g('stddev_samp', 'r', 20)} AS realized_vol_20,
  {g('stddev_samp', 'r', 60)} AS realized_vol_60, {g('avg', 'dv', 20)} AS dollar_volume_20d, {g('avg', 'ill', 20)} AS amihud_illiq_20, {g('max', 'r', 20)} AS max_daily_return_20,
  close / ({g('max', 'close', 60)}) - 1 AS drawdown_60, close / ({g('max', 'close', 252)}) - 1 AS drawdown_252,
  (volume - ({g('avg', 'volume', 20)})) / nullif({g('stddev_samp', 'volume', 20)}, 0) AS volume_shock_zscore_20, {g('avg', 'loc', 20)} AS close_location_20,
  CASE WHEN i > 60 AND count(r) OVER p60 >= 30 THEN covar_samp(r, m) OVER p60 / nullif(var_samp(m) OVER p60, 0) END AS beta_to_market_60,
  CASE WHEN i > 252 AND count(r) OVER p252 >= 100 THEN covar_samp(r, m) OVER p252 / nullif(var_samp(m) OVER p252, 0) END AS beta_to_market_252,
  CASE WHEN i > 60 AND count(r) OVER p60 >= 30 THEN sqrt(greatest(var_samp(r) OVER p60 - (covar_samp(r, m) OVER p60) ** 2 / nullif(var_samp(m) OVER p60, 0), 0)) END AS idiosyncratic_vol_60
  FROM b {windows(5, 20, 21, 60, 63, 126, 252)}, p60 AS {prior(60)}, p252 AS {prior(252)})
SELECT symbol, date, s21 AS momentum_1m, s63 AS momentum_3m, s126 AS momentum_6m, s252 - s21 AS momentum_12m_skip_1m, reversal_1d, s5 AS reversal_5d, s21 AS reversal_1m,
  realized_vol_20, realized_vol_60, beta_to_market_60, beta_to_market_252, idiosyncratic_vol_60, dollar_volume_20d / 1e3 AS dollar_volume_20d, amihud_illiq_20 * 1e6 AS amihud_illiq_20, max_daily_return_20,
  drawdown_60, drawdown_252, volume_shock_zscore_20, close_location_20 FROM c""", " ".join(ft.CHARACTERISTICS), digits=4)
def characteristics_pack(spark, sf):
    d = ft.characteristics(bars(spark, sf)).withColumns({"amihud_illiq_20": F.col("amihud_illiq_20") * 1e6, "dollar_volume_20d": F.col("dollar_volume_20d") / 1e3})
    return d.select("symbol", "date", *ft.CHARACTERISTICS)


@query("WN26", f"""WITH @bars, {R1}, m AS (SELECT *, avg(r1) OVER (PARTITION BY date) AS x FROM r), n AS (SELECT *, x * r1 AS xy FROM m)
SELECT symbol, date, (({g('avg', 'xy', 60)}) - ({g('avg', 'x', 60)}) * ({g('avg', 'r1', 60)})) / ({g('var_samp', 'x', 60)}) AS beta FROM n {windows(60)}""", "beta")
def rolling_index_beta(spark, sf):
    d = bars(spark, sf).withColumn("r1", logret("close", 1, by()))
    d = rk.with_group_stats(d, ["date"], calendar_sized=True, x=F.avg("r1"))
    return ft.rolling_index_beta(d, "r1", "x", 60).select("symbol", "date", "beta")


@query("WN27 UD4", f"""WITH @bars, a AS (SELECT symbol, date, row_number() OVER wk AS t, ln(close) AS lc, coalesce({lr()}, 0) AS r FROM bars {windows()}),
b AS (SELECT *, abs(r) AS ar FROM a), c AS (SELECT symbol, date, {', '.join(f'''CASE WHEN count(lc) OVER w{n} >= {n} THEN regr_slope(lc, t) OVER w{n} END AS s{n},
  CASE WHEN count(lc) OVER w{n} >= {n} THEN least(greatest(regr_r2(lc, t) OVER w{n}, 0), 1) END AS trend_linearity_r2_{n},
  CASE WHEN count(r) OVER w{n} >= {n} THEN max(ar) OVER w{n} / stddev_samp(r) OVER w{n} END AS spikiness_{n}''' for n in (20, 60, 120, 252))} FROM b {windows(20, 60, 120, 252)})
SELECT symbol, date, {', '.join(f'CAST(sign(s{n}) AS DOUBLE) AS trend_direction_{n}, abs(s{n}) AS trend_strength_{n}, trend_linearity_r2_{n}, spikiness_{n}' for n in (20, 60, 120, 252))} FROM c""",
       " ".join(f"trend_strength_{n} trend_linearity_r2_{n} spikiness_{n}" for n in (20, 60, 120, 252)))
def trend_fingerprint(spark, sf):
    return ft.trend_fingerprint(bars(spark, sf)).drop("open", "high", "low", "close", "volume")


@query("WN28", f"""WITH @bars, a AS (SELECT *, (high + low + close) / 3 * volume AS tpv FROM bars)
SELECT symbol, date, ({g('sum', 'tpv', 5)}) / ({g('sum', 'volume', 5)}) AS vwap FROM a {windows(5)}""", "vwap")
def vwap_proxy(spark, sf):
    return ft.vwap_proxy(bars(spark, sf)).select("symbol", "date", "vwap")


@query("WN29", f"""WITH @bars, a AS (SELECT *, {lr()} AS log_return, (high - low) / close AS rg FROM bars {windows()}),
b AS (SELECT symbol, date, log_return, ({g('stddev_samp', 'log_return', 21)}) * sqrt(252) AS realized_vol_21, ({g('stddev_samp', 'log_return', 63)}) * sqrt(252) AS realized_vol_63,
  close / ({g('max', 'close', 60)}) - 1 AS drawdown_60, close / ({g('max', 'close', 252)}) - 1 AS drawdown_252, ({lr(n=50)}) / 50 AS trend_slope_50, ({lr(n=200)}) / 200 AS trend_slope_200,
  {g('avg', 'rg', 20)} AS range_pct_20, CASE WHEN count(volume) OVER w20 >= 20 THEN (volume - avg(volume) OVER w20) / greatest(stddev_samp(volume) OVER w20, 1e-9) END AS volume_zscore_20
  FROM a {windows(20, 21, 60, 63, 252)})
SELECT * FROM b WHERE realized_vol_63 IS NOT NULL AND drawdown_252 IS NOT NULL AND trend_slope_200 IS NOT NULL AND log_return IS NOT NULL""",
       "log_return realized_vol_21 realized_vol_63 drawdown_60 drawdown_252 trend_slope_50 trend_slope_200 range_pct_20 volume_zscore_20")
def index_state_features(spark, sf):
    return ft.index_state_features(bars(spark, sf))


@query("WN30", f"""WITH @bars, a AS (SELECT *, {lr()} AS log_return_1 FROM bars {windows()})
SELECT symbol, date, log_return_1, {lr(n=5)} AS log_return_5, {lr(n=20)} AS log_return_lookback, lead(close, 5) OVER wk / close - 1 AS future_return_horizon,
  {g('stddev_samp', 'log_return_1', 20)} AS realized_vol_20, (volume - ({g('avg', 'volume', 20)})) / (({g('stddev_samp', 'volume', 20)}) + 1e-12) AS volume_z_20,
  CAST(coalesce(sign({lr(n=20)}), 0) AS DOUBLE) AS primary_position FROM a {windows(20)}""",
       "log_return_1 log_return_5 log_return_lookback future_return_horizon realized_vol_20 volume_z_20")
def meta_label_features(spark, sf):
    return ft.meta_label_features(bars(spark, sf)).drop("open", "high", "low", "close", "volume")


IV = """iv AS (SELECT *, 20 + 5 * sin(day(date)) AS vix, 19 + 5 * sin(day(date) + 1) AS vix9d, 21 + 4 * sin(day(date) + 2) AS vix3m,
  90 + 10 * sin(day(date) + 3) AS vvix, 120 + 8 * sin(day(date) * 1.7) AS skew FROM bars)"""


def with_implied(d):
    k = F.dayofmonth("date")
    return d.withColumns({"vix": 20 + 5 * F.sin(k), "vix9d": 19 + 5 * F.sin(k + 1), "vix3m": 21 + 4 * F.sin(k + 2),
                          "vvix": 90 + 10 * F.sin(k + 3), "skew": 120 + 8 * F.sin(k * F.lit(1.7))})


@query("WN31 WN32", f"""WITH @bars, {IV}, a AS (SELECT *, power({lr()}, 2) AS r2 FROM iv {windows()}),
b AS (SELECT *, ({g('sum', 'r2', 21)}) * 12 AS realized_var_annual, (vix / 100) ** 2 AS implied_var_annual FROM a {windows(21)}), c AS (SELECT *, implied_var_annual - realized_var_annual AS vrp FROM b)
SELECT symbol, date, realized_var_annual, implied_var_annual, vrp, vix9d / vix AS term_9d_30d, vix3m / vix AS term_30d_3m, vvix / vix AS vvix_to_vix,
  CASE WHEN count(skew) OVER w60 >= 60 THEN (skew - avg(skew) OVER w60) / greatest(stddev_samp(skew) OVER w60, 1e-6) END AS skew_z60,
  CASE WHEN count(vrp) OVER w60 >= 60 THEN (vrp - avg(vrp) OVER w60) / greatest(stddev_samp(vrp) OVER w60, 1e-9) END AS vrp_z60,
  vix / 100 - sqrt(realized_var_annual) AS vrp_vol, false AS options_fallback FROM c {windows(60)}""",
       "realized_var_annual implied_var_annual vrp term_9d_30d term_30d_3m vvix_to_vix skew_z60 vrp_z60 vrp_vol")
def variance_premium(spark, sf):
    d = ft.implied_vol_features(ft.variance_premium(with_implied(bars(spark, sf))))
    return d.drop("open", "high", "low", "close", "volume", "vix", "vix9d", "vix3m", "vvix", "skew")


@query("JN10 WN33", """WITH @bars, ev AS (SELECT date FROM (SELECT DISTINCT date FROM bars) WHERE day(date) = 15 AND month(date) % 3 = 1),
a AS (SELECT b.symbol, b.date, ev.date IS NOT NULL AS e, row_number() OVER (PARTITION BY symbol ORDER BY b.date) AS i FROM bars b LEFT JOIN ev ON b.date = ev.date),
c AS (SELECT *, least(coalesce(min(CASE WHEN e THEN i END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - i, 9999), 9999) AS nx,
  least(coalesce(i - max(CASE WHEN e THEN i END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9999), 9999) AS pv,
  lead(date) OVER (PARTITION BY symbol ORDER BY date) AS ld FROM a)
SELECT symbol, date, nx AS days_to_next_event, pv AS days_since_last_event, e AS event_t0, nx = 1 AS event_tm1, pv = 1 AS event_tp1, least(nx, pv) <= 2 AS event_win2, least(nx, pv) <= 5 AS event_win5,
  ld IS NULL OR date_trunc('month', ld) <> date_trunc('month', date) AS is_month_end, ld IS NULL OR date_trunc('quarter', ld) <> date_trunc('quarter', date) AS is_quarter_end,
  (month(date) IN (1, 4, 7, 10) AND day(date) >= 15) OR (month(date) IN (2, 5, 8, 11) AND day(date) <= 15) AS in_earnings_season FROM c""")
def event_features(spark, sf):
    b = bars(spark, sf)
    ev = b.select("date").distinct().filter((F.dayofmonth("date") == 15) & (F.month("date") % 3 == 1))
    return ft.event_features(b, ev).drop("open", "high", "low", "close", "volume")


@query("WN34", f"""WITH RECURSIVE @bars, s AS (SELECT symbol, date, close, row_number() OVER wk AS i FROM bars WHERE date < DATE '1996-01-01' {windows()}),
e AS (SELECT symbol, date, i, close AS n5, 1.0::DOUBLE AS d5, close AS n20, 1.0::DOUBLE AS d20 FROM s WHERE i = 1
  UNION ALL SELECT s.symbol, s.date, s.i, s.close + (2.0 / 3) * n5, 1 + (2.0 / 3) * d5, s.close + (19.0 / 21) * n20, 1 + (19.0 / 21) * d20 FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1)
SELECT symbol, count(*) AS n_rows, sum(n5 / d5) AS sum_ewm5, sum(n20 / d20) AS sum_ewm20, min(n5 / d5) AS min_ewm5, max(n20 / d20) AS max_ewm20 FROM e GROUP BY symbol""".replace(" WHERE date < DATE '1996-01-01'", ""),
       "sum_ewm5 sum_ewm20 min_ewm5 max_ewm20", digits=3)
def ewma_summary(spark, sf):
    d = ft.ewmas(bars(spark, sf), {"e5": ("close", 5), "e20": ("close", 20)})
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("e5").alias("sum_ewm5"), F.sum("e20").alias("sum_ewm20"),
                                   F.min("e5").alias("min_ewm5"), F.max("e20").alias("max_ewm20"))


@query("WN35 UD3", f"""WITH @bars, a AS (SELECT symbol, date, (high + low + close) / 3 AS tp FROM bars),
b AS (SELECT *, {g('avg', 'tp', 20)} AS mu, list(tp) OVER w20 AS l FROM a {windows(20)})
SELECT symbol, date, CASE WHEN mu IS NOT NULL THEN list_sum(list_transform(l, lambda v: abs(v - mu))) / 20 END AS mad FROM b""", "mad", digits=4)
def rolling_mean_abs_deviation(spark, sf):
    d = bars(spark, sf).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3.0)
    return ft.rolling_mad(d, "tp", 20, "mad").select("symbol", "date", "mad")


@query("WN36", f"""WITH @bars, a AS (SELECT *, row_number() OVER wk AS i FROM bars {windows()})
SELECT symbol, date, CASE WHEN i > 20 THEN i - arg_max(i, (high, -i)) OVER w20 END AS since_high, CASE WHEN i > 20 THEN i - arg_min(i, (low, i)) OVER w20 END AS since_low FROM a {windows(20)}""")
def days_since_extreme(spark, sf):
    d = ft.days_since_extreme(bars(spark, sf), 20)
    return d.select("symbol", "date", F.col("since_high").cast("long"), F.col("since_low").cast("long"))


@query("WN37 WN38", f"""WITH @bars, r AS (SELECT symbol, date, coalesce(close / lag(close) OVER wk - 1, 0) * 0.01 AS ret FROM bars {windows()}),
e AS (SELECT *, product(1 + ret) OVER {SOFAR} AS eq FROM r), p AS (SELECT *, eq / max(eq) OVER {SOFAR} - 1 AS dd FROM e),
k AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER {SOFAR} AS grp FROM p),
l AS (SELECT symbol, grp, sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) AS run, min(dd) AS dd FROM k GROUP BY 1, 2)
SELECT symbol, min(dd) AS max_drawdown, CAST(max(run) AS BIGINT) AS longest_underwater FROM l GROUP BY symbol""", "max_drawdown")
def drawdown_stats(spark, sf):
    d = bars(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1.0, F.lit(0.0)) * 0.01)
    return ft.underwater_runs(ft.drawdown(d, "ret", ["symbol"], ["date"]), ["symbol"], ["date"])


@query("WN42 FN11 PT2", f"""WITH @bars, s AS (SELECT symbol, date, CASE WHEN close > open * 1.2 THEN 1.0 WHEN close < open * 0.8 THEN -1.0 ELSE 0.0 END::DOUBLE AS sig FROM bars)
SELECT symbol, date, coalesce(last_value(nullif(sig, 0) IGNORE NULLS) OVER w5, 0) AS held5, last_value(nullif(sig, 0) IGNORE NULLS) OVER {SOFAR} AS filled,
  first_value(sig) OVER (PARTITION BY symbol, extract(isoyear FROM date), extract(week FROM date) ORDER BY date) AS sig_weekly FROM s {windows(5)}""")
def holding_and_fill(spark, sf):
    c, o = F.col("close"), F.col("open")
    d = bars(spark, sf).withColumn("sig", F.when(c > o * 1.2, 1.0).when(c < o * 0.8, -1.0).otherwise(0.0))
    d = ft.weekly_hold(d, "sig").withColumn("held5", ft.held("sig", 5)).withColumn(
        "filled", ft.forward_fill(F.when(F.col("sig") != 0, F.col("sig")), ["symbol"], ["date"]))
    return d.select("symbol", "date", "held5", "filled", "sig_weekly")


@query("WN44 RK1 FN10", f"""WITH @bars, @membership, {R1}, a AS (SELECT r.symbol, r.date, {lr(n=20)} AS log_return_20, {g('stddev_samp', 'r1', 20)} AS realized_vol_20,
  CASE WHEN count(volume) OVER w20 >= 20 THEN (volume - avg(volume) OVER w20) / greatest(stddev_samp(volume) OVER w20, 1e-9) END AS vz, stddev_samp(r1) OVER (PARTITION BY r.date) AS cross_sectional_dispersion,
  coalesce(in_index, false) AS in_index FROM r LEFT JOIN membership m ON r.symbol = m.symbol AND r.date = m.date
  WINDOW wk AS (PARTITION BY r.symbol ORDER BY r.date), w20 AS (PARTITION BY r.symbol ORDER BY r.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
k AS (SELECT symbol, date, {', '.join(f'CASE WHEN {c} IS NOT NULL AND count(*) OVER d > 1 THEN (row_number() OVER (PARTITION BY date ORDER BY {c} NULLS LAST, symbol) - 1.0) / (count(*) OVER d - 1.0) - 0.5 END AS {n}'
    for c, n in (('log_return_20', 'rank_log_return_20'), ('realized_vol_20', 'rank_realized_vol_20'), ('vz', 'rank_volume_zscore_20d')))} FROM a WHERE in_index WINDOW d AS (PARTITION BY date))
SELECT a.symbol, a.date, a.in_index, log_return_20, realized_vol_20, cross_sectional_dispersion, rank_log_return_20, rank_realized_vol_20, rank_volume_zscore_20d,
  sqrt(-2 * ln((CAST('0x' || substr(md5('42:1|' || a.date || '|' || a.symbol), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)) * cos(2 * pi() * (CAST('0x' || substr(md5('42:2|' || a.date || '|' || a.symbol), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS noise_sentinel
FROM a LEFT JOIN k ON a.symbol = k.symbol AND a.date = k.date""",
       "log_return_20 realized_vol_20 cross_sectional_dispersion rank_log_return_20 rank_realized_vol_20 rank_volume_zscore_20d noise_sentinel")
def composed_features(spark, sf):
    # joined as both sides are aggregated, then partitioned once for all windows by symbol
    b = daily(spark, sf).join(membership(spark, sf), ["symbol", "date"], "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))
    d = ft.build_features(by_symbol(b, sf))
    return d.select("symbol", "date", "in_index", "log_return_20", "realized_vol_20", "cross_sectional_dispersion", "rank_log_return_20",
                    "rank_realized_vol_20", "rank_volume_zscore_20d", "noise_sentinel")


@query("RK2 RK3", """WITH @bars, a AS (SELECT symbol, date, close / open - 1 AS x, close > 1000 AND symbol % 4 <> 0 AS ok FROM bars),
e AS (SELECT symbol, date, row_number() OVER (PARTITION BY date ORDER BY x, symbol) AS rank, count(*) OVER (PARTITION BY date) AS n_eligible FROM a WHERE ok)
SELECT a.symbol, a.date, row_number() OVER (PARTITION BY a.date ORDER BY x, a.symbol) - 1 AS x_rank, e.rank, e.n_eligible FROM a LEFT JOIN e ON a.symbol = e.symbol AND a.date = e.date""")
def ordinal_ranks(spark, sf):
    d = bars(spark, sf).select("symbol", "date", (F.col("close") / F.col("open") - 1).alias("x"), ((F.col("close") > 1000) & (F.col("symbol") % 4 != 0)).alias("ok"))
    d = rk.zero_based_rank(rk.eligible_rank(d, "x", F.col("ok")), "x", "x_rank")
    return d.select("symbol", "date", "x_rank", "rank", "n_eligible")


@query("RK4", f"""WITH @bars, a AS (SELECT symbol, date, close / lag(close, 5) OVER wk - 1 AS p, lead(close) OVER wk / close - 1 AS y FROM bars {windows()}),
b AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY p, symbol) AS rp, row_number() OVER (PARTITION BY date ORDER BY y, symbol) AS ry FROM a WHERE p IS NOT NULL AND y IS NOT NULL),
c AS (SELECT date, count(*) AS n, corr(rp, ry) AS ic FROM b GROUP BY date HAVING count(*) >= 3)
SELECT count(*) AS n_dates, avg(ic) AS rank_ic_mean, stddev_pop(ic) AS rank_ic_std FROM c""", "rank_ic_mean rank_ic_std")
def rank_ic(spark, sf):
    w = by()
    d = bars(spark, sf).withColumns({"p": div("close", F.lag("close", 5).over(w)) - 1.0, "y": div(F.lead("close").over(w), "close") - 1.0})
    ic = rk.rank_ic_by_date(d.select("symbol", "date", "p", "y"), "p", "y")
    return ic.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("rank_ic").alias("rank_ic_mean"), F.stddev_pop("rank_ic").alias("rank_ic_std"))


@query("RK5", """WITH s AS (SELECT c_custkey AS symbol, c_mktsegment AS cohort, c_acctbal AS x, coalesce(sum(o_totalprice), 0) AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3),
b AS (SELECT cohort, y, row_number() OVER (PARTITION BY cohort ORDER BY x, symbol) AS rx, row_number() OVER (PARTITION BY cohort ORDER BY y, symbol) AS ry, count(*) OVER (PARTITION BY cohort) AS n FROM s),
q AS (SELECT *, least((rx - 1) * 5 // n, 4) AS bucket FROM b)
SELECT cohort, count(*) AS n, corr(rx, ry) AS rho, corr(rx, ry) * sqrt((count(*) - 2) / (1 - corr(rx, ry) ** 2)) AS t_stat,
 avg(CASE WHEN bucket = 4 THEN y END) - avg(CASE WHEN bucket = 0 THEN y END) AS quintile_spread FROM q GROUP BY cohort""", "rho t_stat quintile_spread", digits=4)
def spearman_by_cohort(spark, sf):
    from quantloom.plans.views import table
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spend = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("y"))
    d = c.join(spend, c.c_custkey == spend.o_custkey, "left").select(
        F.col("c_custkey").alias("symbol"), F.col("c_mktsegment").alias("cohort"), F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    rho = rk.spearman(d, "x", "y", ["cohort"], ["symbol"])
    r = rk.ordinal(d, "x", "_r", ["cohort"], ["symbol"], size="_n")
    bucket = F.least(F.floor((F.col("_r") - 1) * 5 / F.col("_n")), F.lit(4))
    spread = r.groupBy("cohort").agg((F.avg(F.when(bucket == 4, F.col("y"))) - F.avg(F.when(bucket == 0, F.col("y")))).alias("quintile_spread"))
    return rho.join(spread, "cohort")
