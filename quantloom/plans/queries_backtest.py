"""Position, cost, back-test and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.functions.noise import uniform
from quantloom.operators import backtest as bt
from quantloom.operators import joins as jn
from quantloom.operators import metrics as mt
from quantloom.operators import positions as ps
from quantloom.operators import ticks as tk
from quantloom.plans.queries_market import CARRY_SQL, carry_inputs
from quantloom.plans.registry import query
from quantloom.plans.sqltext import SOFAR, g, windows
from quantloom.plans.views import bars, dividends, scored, sectors, table, ticks

# A smooth price per (symbol, date) for path statistics: the bound closes jump too much to compound.
SMOOTH = "sm AS (SELECT symbol, date, 100 + 10 * sin(symbol + (date - DATE '1995-01-01') * 0.05) + 5 * cos((date - DATE '1995-01-01') * 0.31) AS close, sign(close / open - 1) AS signal FROM bars)"


def smooth(spark, sf):
    t = F.datediff("date", F.lit("1995-01-01").cast("date"))
    d = bars(spark, sf).withColumn("signal", F.signum(F.col("close") / F.col("open") - 1))
    return d.select("symbol", "date", (100 + 10 * F.sin(F.col("symbol") + t * F.lit(0.05)) + 5 * F.cos(t * F.lit(0.31))).alias("close"), "signal")


SA = """a AS (SELECT *, coalesce(close / lag(close) OVER k - 1, 0) AS ur, coalesce(lag(least(greatest(signal, -1), 1)) OVER k, 0) AS pos FROM sm WINDOW k AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY date), 0)) AS turn FROM a), sa AS (SELECT *, pos * ur - turn * 1.5e-4 AS net FROM b)"""


def dd_sql(rel: str, ret: str, key: str, date: str = "date") -> str:
    return f"""(SELECT {key}, min(e / p - 1) AS max_drawdown FROM (SELECT *, max(e) OVER (PARTITION BY {key} ORDER BY {date}) AS p FROM (SELECT *, product(1 + {ret}) OVER (PARTITION BY {key} ORDER BY {date}) AS e FROM {rel})) GROUP BY {key})"""


@query("BT1 MT1 MT2 MT3 PT6", f"""WITH @bars, {SMOOTH}, {SA}, m AS (SELECT symbol, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, avg(net) / stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(252) AS sortino, product(1 + net) - 1 AS total_return,
  avg(CASE WHEN net > 0 THEN 1.0 WHEN net < 0 THEN 0.0 END) AS hit_rate, count_if(turn > 1e-12) AS n_trades, avg(abs(pos)) AS avg_position, sum(turn) * 252 / count(*) AS annual_turnover FROM sa GROUP BY symbol)
SELECT m.*, max_drawdown FROM m JOIN {dd_sql('sa', 'net', 'symbol')} d ON m.symbol = d.symbol""", "sharpe sortino total_return hit_rate avg_position annual_turnover max_drawdown")
def single_asset_backtest(spark, sf):
    return bt.single_asset_summary(bt.single_asset(smooth(spark, sf)))


@query("BT2 PT3 PT5", f"""WITH @bars, {SMOOTH}, h AS (SELECT *, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS raw FROM sm),
d AS (SELECT *, coalesce(lag(raw) OVER k, 0) AS pos, coalesce(close / lag(close) OVER k - 1, 0) AS r, coalesce(lead(close, 3) OVER k, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ex FROM h WINDOW k AS (PARTITION BY symbol ORDER BY date)),
e AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY date), 0) AS pp FROM d)
SELECT symbol, date, pp AS position, abs(pos - pp) AS turnover, pp * r AS gross_return, pp * r - abs(pos - pp) * 0.0005 AS net_return, sign(pos) * (ex / close - 1) AS realized_mid_return, abs(pos - pp) > 0 AS is_trade FROM e""", "position turnover gross_return net_return realized_mid_return")
def bar_backtest(spark, sf):
    d = smooth(spark, sf).withColumn("raw_position", ps.minimum_holding(ps.threshold_side("signal", 0.5), 3))
    d = bt.bar_backtest(d, delay=1, horizon=3)
    return d.select("symbol", "date", "position", "turnover", "gross_return", "net_return", "realized_mid_return", "is_trade")


@query("PT4", f"""WITH RECURSIVE @bars, {SMOOTH}, p AS (SELECT symbol, signal AS p, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM sm),
r AS (SELECT symbol, i, p, p AS cur, CASE WHEN p <> 0 THEN 1 ELSE -4 END::BIGINT AS ent FROM p WHERE i = 1 UNION ALL SELECT p.symbol, p.i, p.p, CASE WHEN p.p = 0 THEN 0 WHEN p.p <> cur AND p.i - ent >= 5 THEN p.p ELSE cur END, CASE WHEN p.p <> 0 AND p.p <> cur AND p.i - ent >= 5 THEN p.i ELSE ent END FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i + 1)
SELECT symbol, count(*) AS n, CAST(sum(abs(cur)) AS DOUBLE) AS active, count_if(cur <> p) AS changed FROM r GROUP BY symbol""", "active")
def cooldown_positions(spark, sf):
    d = ps.cooldown(smooth(spark, sf).withColumn("p", F.when(F.abs("signal") > 0, F.col("signal")).otherwise(0.0)), "p", 5)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("cooled")).alias("active"), F.count_if(F.col("cooled") != F.col("p")).alias("changed"))


@query("PT1 PT2 PT5", f"""WITH @bars, a AS (SELECT symbol, date, close / open - 1 AS s, close / lag(close) OVER wk - 1 AS r FROM bars {windows()}), v AS (SELECT *, {g('stddev_samp', 'r', 20)} AS v FROM a {windows(20)}),
q AS (SELECT *, avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m, count(v) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS c FROM v)
SELECT symbol, date, greatest(s, 0) AS long_only, CASE WHEN v > 0 THEN least(greatest(s * (0.1 / v), -3), 3) ELSE 0 END AS scaled, coalesce(c >= 30 AND v <= m, false) AS vol_ok, CASE WHEN s > 0.25 THEN 1.0 ELSE 0.0 END AS side FROM q""", "long_only scaled side")
def position_transforms(spark, sf):
    d = bars(spark, sf).withColumn("s", F.col("close") / F.col("open") - 1)
    from quantloom.functions.rolling import rolling
    d = rolling(d.withColumn("r", div("close", F.lag("close").over(by())) - 1), {"v": ("std", "r", 20)})
    d = ps.vol_filter(d, "low", short=20, short_min=20, long=60, long_min=30)
    return d.select("symbol", "date", ps.position_mode("s", "long_only").alias("long_only"), ps.vol_target("s", "v", 0.1).alias("scaled"), "vol_ok", ps.threshold_side("s", 0.1, "long_only", min_edge=0.25).alias("side"))


@query("PT7 BT16", f"""WITH @bars, {SMOOTH}, w AS (SELECT *, CASE WHEN signal > 0 THEN 1.0 / greatest(sum(CASE WHEN signal > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY date), 1) ELSE 0 END AS wt, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS ret FROM sm),
l AS (SELECT *, coalesce(lag(wt) OVER (PARTITION BY symbol ORDER BY date), 0) AS p FROM w), t AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY symbol ORDER BY date), 0)) AS t FROM l)
SELECT date, sum(p * ret) AS gross_return, sum(t * CASE WHEN symbol = 1 THEN 10 ELSE 5 END / 1e4) AS cost, sum(t) AS turnover, sum(p * ret) - sum(t * CASE WHEN symbol = 1 THEN 10 ELSE 5 END / 1e4) AS net_return FROM t GROUP BY date""", "gross_return cost turnover net_return", digits=7)
def allocator_pnl(spark, sf):
    d = smooth(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0)))
    d = ps.equal_sleeves(d.withColumn("weight", F.when(F.col("signal") > 0, 1.0).otherwise(0.0)), "weight")
    return bt.allocator(d, {"1": 10.0})


BOOK_SQL = f"""p AS (SELECT symbol, date AS execution_date, open, high, low, close, sign(close / open - 1) * ((symbol * 7919 + CAST(date - DATE '1995-01-01' AS BIGINT) * 104729) % 1009) AS pred, lag(close * volume) OVER (PARTITION BY symbol ORDER BY date) AS dv FROM bars),
p2 AS (SELECT *, CASE WHEN count(dv) OVER w >= 20 THEN avg(dv) OVER w END AS adv FROM p WINDOW w AS (PARTITION BY symbol ORDER BY execution_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, row_number() OVER (PARTITION BY execution_date ORDER BY pred, symbol) AS rk, count(*) OVER (PARTITION BY execution_date) AS n FROM p2 WHERE adv IS NOT NULL),
k AS (SELECT *, greatest(CAST(round_even(n * 0.1, 0) AS BIGINT), 1, 2) AS kk FROM r), bk AS (SELECT execution_date, symbol, close, open AS fill, CASE WHEN rk > n - kk THEN 1 ELSE -1 END * least(500000.0 / kk, adv * 0.01, 50000.0) AS signed FROM k WHERE 2 * kk <= n AND (rk > n - kk OR rk <= kk)),
dy AS (SELECT execution_date, row_number() OVER (ORDER BY execution_date) AS no FROM (SELECT DISTINCT execution_date FROM bk)), b2 AS (SELECT bk.*, no FROM bk JOIN dy USING (execution_date)),
m AS (SELECT coalesce(a.no, b.no + 1) AS no, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.signed, 0) AS sn, coalesce(b.signed, 0) AS sp, b.close AS cp, a.fill, a.symbol IS NOT NULL AS isnew FROM b2 a FULL JOIN b2 b ON a.no = b.no + 1 AND a.symbol = b.symbol),
m2 AS (SELECT m.*, dy.execution_date AS date, p.close AS ct FROM m JOIN dy ON m.no = dy.no LEFT JOIN p ON p.symbol = m.symbol AND p.execution_date = dy.execution_date)"""


def book_panel(spark, sf):
    b = bars(spark, sf)
    t = F.datediff("date", F.lit("1995-01-01").cast("date"))
    sig = b.select("symbol", "date", (F.signum(F.col("close") / F.col("open") - 1) * ((F.col("symbol") * 7919 + t.cast("long") * 104729) % 1009)).alias("y_xs_pred"))
    return ps.to_book_panel(sig, b, sectors(spark, sf))


@query("BT7 RK7 BT8 BT9 BT10 BT11 PT8", f"""WITH @bars, {BOOK_SQL} SELECT date, sum(CASE WHEN sp <> 0 AND cp IS NOT NULL AND ct IS NOT NULL THEN sp * (ct / cp - 1) ELSE 0 END) + sum(CASE WHEN sn <> sp AND fill IS NOT NULL AND ct IS NOT NULL THEN (sn - sp) / fill * (ct - fill) ELSE 0 END) AS price_pnl,
 sum(abs(sn - sp)) * 0.5e-4 AS commission_drag, sum(abs(sn - sp) * 15 * CASE WHEN isnew AND date < DATE '2001-04-09' THEN 2.5 ELSE 1 END / 2 / 1e4) AS spread_drag, sum(CASE WHEN sn < 0 THEN -sn * 100 / 1e4 / 252 ELSE 0 END) AS borrow_drag, sum(abs(sn)) AS gross_notional, greatest(sum(abs(sn)) - 1e6, 0) * 0.05 / 252 AS financing_drag
FROM m2 GROUP BY date""", "price_pnl commission_drag spread_drag borrow_drag gross_notional financing_drag", digits=4)
def book_backtest(spark, sf):
    d = bt.book_backtest(book_panel(spark, sf), q=0.1, min_names=2)
    return d.select("date", "price_pnl", "commission_drag", "spread_drag", "borrow_drag", "gross_notional", "financing_drag")


@query("BT10 FN8", """WITH @bars SELECT symbol, date, CASE WHEN symbol % 97 = 0 OR CAST(date - DATE '1995-01-01' AS INTEGER) < 183 OR close * volume < 20000 OR (CASE WHEN symbol % 2 = 0 THEN close END) < 1000 THEN 'hard' ELSE 'general' END AS tier FROM bars""".replace("close * volume < 20000", "close * volume * 100 < 5000000").replace("< 1000 THEN", "/ 200 < 5 THEN"))
def borrow_tiers(spark, sf):
    no = F.lit(None).cast("double")
    d = bars(spark, sf)
    tier = bt.borrow_tier(F.col("date"), F.lit("1995-01-01").cast("date"), F.col("close") * F.col("volume") * 100, no, F.when(F.col("symbol") % 2 == 0, F.col("close") / 200), F.lit(False), no, F.col("symbol") % 97 == 0)
    return d.select("symbol", "date", tier.alias("tier"))


@query("BT12", """WITH @bars, @dividends, a AS (SELECT symbol, date, open, close, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, sum(CASE WHEN pc IS NOT NULL THEN 1000 * (close / pc - 1) ELSE 0 END) + sum(500 / open * (close - open)) AS price_pnl, (SELECT sum(1000 / a2.pc * dividend_per_share) FROM a a2 JOIN dividends d ON a2.symbol = d.symbol AND a2.date = d.ex_date WHERE a2.symbol = a.symbol) AS dividend_pnl FROM a GROUP BY symbol""", "price_pnl dividend_pnl", digits=3)
def position_pnl(spark, sf):
    a = bars(spark, sf).withColumn("pc", F.lag("close").over(by()))
    held = a.filter("pc IS NOT NULL").select("symbol", "date", F.lit(1000.0).alias("signed_notional_prev"), F.col("close").alias("close_today"), F.col("pc").alias("close_prev"))
    lots = a.select("symbol", "date", F.lit(500.0).alias("signed_notional_new"), F.col("close").alias("close_today"), F.col("open").alias("fill_price"))
    pnl = bt.position_price_pnl(held, lots).groupBy("symbol").agg(F.sum("price_pnl").alias("price_pnl"))
    dv = bt.cash_dividend_pnl(a.select("symbol", "date", F.lit(1000.0).alias("signed_notional"), F.col("pc").alias("ref_close")), dividends(spark, sf))
    return pnl.join(dv.groupBy("symbol").agg(F.sum("cash_dividend_pnl").alias("dividend_pnl")), "symbol", "left")


@query("BT13 BT14", f"""WITH @bars, {SMOOTH}, r AS (SELECT *, coalesce(close / lag(close) OVER k - 1, 0) AS ret, coalesce(lag(signal, 2) OVER k, 0) AS p, coalesce(lag(signal, 1) OVER k, 0) AS q FROM sm WINDOW k AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT symbol, date, p * ret - abs(p - coalesce(lag(p) OVER k, 0)) * 2e-4 AS a, q * ret - abs(q - coalesce(lag(q) OVER k, q)) * 1e-4 AS b FROM r WINDOW k AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, sum(a) AS timing_total, avg(a) / stddev_samp(a) * sqrt(252) AS timing_sharpe, sum(b) AS held_total, avg(b) / stddev_samp(b) * sqrt(252) AS held_sharpe FROM t GROUP BY symbol""", "timing_total timing_sharpe held_total held_sharpe")
def timing_backtests(spark, sf):
    d = smooth(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0))).withColumnRenamed("signal", "signal")
    a = bt.timing(d, delay=1).groupBy("symbol").agg(F.sum("net_return").alias("timing_total"), mt.sharpe("net_return").alias("timing_sharpe"))
    b = bt.held_positions(d.withColumn("position", F.col("signal")), delay=1).groupBy("symbol").agg(F.sum("net_return").alias("held_total"), mt.sharpe("net_return").alias("held_sharpe"))
    return a.join(b, "symbol")


@query("BT15 JN8", f"""WITH @bars, {SMOOTH}, dates AS (SELECT DISTINCT date FROM bars), rates AS (SELECT date, 0.01 + 0.0001 * day(date) AS annual_rate FROM dates WHERE day(date) % 10 = 5),
c AS (SELECT date, coalesce(last_value(annual_rate IGNORE NULLS) OVER (ORDER BY date), 0) AS r FROM dates LEFT JOIN rates USING (date)), y AS (SELECT date, 'zero' AS assumption, 0 AS cy FROM c UNION ALL SELECT date, 'tbill', r / 365 FROM c UNION ALL SELECT date, 'tbill_minus_25bps', (r - 0.0025) / 365 FROM c),
s AS (SELECT *, CASE WHEN signal > 0 THEN 1.0 ELSE 0 END AS sg, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS ret FROM sm), o AS (SELECT *, coalesce(lag(sg) OVER (PARTITION BY symbol ORDER BY date), 0) AS n FROM s), t AS (SELECT *, abs(n - coalesce(lag(n) OVER (PARTITION BY symbol ORDER BY date), 0)) AS tt FROM o)
SELECT symbol, assumption, sum(n * ret + (1 - n) * cy - tt * 1e-4) AS total FROM t JOIN y USING (date) GROUP BY 1, 2""", "total")
def long_or_cash(spark, sf):
    d = smooth(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0))).withColumn("signal", F.when(F.col("signal") > 0, 1.0).otherwise(0.0))
    dates = d.select("date").distinct()
    rates = dates.filter(F.dayofmonth("date") % 10 == 5).withColumn("annual_rate", 0.01 + 0.0001 * F.dayofmonth("date"))
    return bt.long_or_cash(d, rates).groupBy("symbol", "assumption").agg(F.sum("net_return").alias("total"))


CARRY_RUN = """c AS (SELECT *, lag(spot) OVER w IS NULL AS fst, lead(spot) OVER w IS NULL AS lst, coalesce(spot / lag(spot) OVER w - 1, 0) - coalesce(perp / lag(perp) OVER w - 1, 0) AS price, perp_high / spot_low - 1 - coalesce(lag(basis) OVER w, basis) AS adv
 FROM (SELECT p.*, funding, perp / spot - 1 AS basis FROM p JOIN f ON p.symbol = f.symbol AND p.date = f.date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
n AS (SELECT *, price + CASE WHEN fst THEN 0 ELSE funding END AS gross, (CASE WHEN fst THEN 1 ELSE 0 END + CASE WHEN lst THEN 1 ELSE 0 END + CASE WHEN fst THEN 0 ELSE abs(price) END) * 25e-4 AS cost FROM c)"""


@query("BT17 BT18", f"""WITH @bars, {CARRY_SQL}, {CARRY_RUN}, l AS (SELECT symbol, date, lev, gross - cost - CASE WHEN adv > 1 / lev THEN 1 / lev + 25e-4 ELSE 0 END AS net, adv > 1 / lev AS liq FROM n, (SELECT unnest([50.0, 100.0, 200.0]) AS lev))
SELECT symbol, CAST(lev AS DOUBLE) AS leverage, sum(net) AS total_net, avg(net) / stddev_samp(net) * sqrt(365) AS sharpe, count_if(liq) AS n_liquidations FROM l GROUP BY 1, 2""", "total_net sharpe", digits=5)
def carry_liquidation(spark, sf):
    panel = jn.adverse_basis(jn.carry_panel(*carry_inputs(spark, sf)))
    d = bt.liquidation_stress(bt.carry(panel, slip_bps=5.0), (50.0, 100.0, 200.0))
    return d.groupBy("symbol", "leverage").agg(F.sum("net").alias("total_net"), mt.sharpe("net", 365.0).alias("sharpe"), F.count_if("liquidated").alias("n_liquidations"))


@query("BT17 BT18 AG13", f"""WITH @bars, {CARRY_SQL}, {CARRY_RUN}, z AS (SELECT symbol, sum(-price - CASE WHEN fst THEN 0 ELSE funding END - (cost / 25e-4 * 15e-4)) AS inverted, sum(price - cost / 25e-4 * 15e-4) AS zero_funding, sum(gross - cost / 25e-4 * 15e-4) AS base FROM n GROUP BY symbol)
SELECT z.*, (SELECT max(adv) * 100 FROM c) AS max_pct, (SELECT quantile_cont(adv, 0.999) * 100 FROM c) AS p999_pct, (SELECT count_if(adv > 1 / 100.0) FROM c) AS liq_100x FROM z""", "inverted zero_funding base max_pct p999_pct")
def carry_placebos(spark, sf):
    panel = jn.adverse_basis(jn.carry_panel(*carry_inputs(spark, sf)))
    total = lambda d, n: d.groupBy("symbol").agg(F.sum("net").alias(n))
    d = total(bt.carry(panel, invert=True), "inverted").join(total(bt.carry(panel, zero_funding=True), "zero_funding"), "symbol").join(total(bt.carry(panel), "base"), "symbol")
    return d.crossJoin(bt.liquidation_tail(panel, [100.0]).select("max_pct", "p999_pct", "liq_100x"))  # one-row side


TRADES_SQL = """q AS (SELECT symbol, trade_id, event_time, price, price * (1 - 1e-4) AS best_bid, price * (1 + 1e-4) AS best_ask, lead(price, 5) OVER k AS fp, (trade_id * 7919 % 1009 - 504) / 504.0 * 0.01 AS pred FROM ticks WINDOW k AS (PARTITION BY symbol ORDER BY event_time, trade_id)),
t AS (SELECT *, CASE WHEN pred > 0 THEN fp * (1 - 1e-4) / best_ask - 1 ELSE best_bid / (fp * (1 + 1e-4)) - 1 END * 0.01 AS gross FROM q WHERE fp IS NOT NULL AND abs(pred) > 0.002 AND pred <> 0), tr AS (SELECT *, gross - 2e-4 AS net FROM t)"""


def taker_table(spark, sf):
    d = tk.trade_flow_features(ticks(spark, sf), horizons=(5,), windows=(1,), ties=["trade_id"])
    d = d.withColumn("prediction", (F.col("trade_id") * 7919 % 1009 - 504) / 504.0 * 0.01)
    t = bt.taker_trades(d, 5, fee_bps=0.0, slippage_bps=0.0, min_signal_abs=0.002, max_relative_spread=0.01, min_depth=0.5)
    # the bound prices jump, so the returns are scaled before compounding
    return t.withColumn("gross_return", F.col("gross_return") * 0.01).withColumn("net_return", F.col("gross_return") - 2e-4)


@query("BT4 PRJ16 MT3", f"""WITH @ticks, {TRADES_SQL}, e AS (SELECT *, sum(ln(1 + net)) OVER (ORDER BY symbol, event_time, trade_id) AS le FROM tr), m AS (SELECT *, max(le) OVER (ORDER BY symbol, event_time, trade_id) AS lp FROM e)
SELECT count(*) AS trade_count, sum(ln(1 + gross)) AS log_gross, sum(ln(1 + net)) AS log_net, avg(net) / stddev_samp(net) * sqrt(count(*)) AS trade_sharpe, avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0 END) AS gross_hit_rate, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS net_hit_rate,
 sum(greatest(net, 0)) / sum(greatest(-net, 0)) AS profit_factor, avg(gross) AS avg_trade_gross_return, avg(net) AS avg_trade_net_return, count_if(pred > 0) AS long_trade_count, count_if(pred <= 0) AS short_trade_count, sum(CASE WHEN pred > 0 THEN net ELSE 0 END) AS long_net_pnl_sum,
 sum(CASE WHEN pred > 0 THEN 0 ELSE net END) AS short_net_pnl_sum, min(exp(le - lp) - 1) AS max_drawdown FROM m""",
       "log_gross log_net trade_sharpe gross_hit_rate net_hit_rate profit_factor avg_trade_gross_return avg_trade_net_return long_net_pnl_sum short_net_pnl_sum max_drawdown", digits=5)
def taker_event_backtest(spark, sf):
    t = taker_table(spark, sf)
    return mt.trade_metrics(t).crossJoin(mt.event_path(t, "net_return", ties=["trade_id"]).select(F.col("drawdown").alias("max_drawdown")))  # one-row tables


@query("BT5 BT6 AG1", f"""WITH @ticks, {TRADES_SQL}, b AS (SELECT symbol, event_time, CASE WHEN pred > 0 THEN fp / price - 1 ELSE 1 - fp / price END * 1.0 AS g, 2e-4 AS sc, 1e-4 AS fc, 1e-4 AS slc FROM q WHERE fp IS NOT NULL AND pred <> 0 AND abs(pred) >= 2 * 4e-4),
r AS (SELECT *, g - ks * sc - kf * (fc + slc) AS net FROM b, (VALUES ('no_cost', 0, 0), ('spread_only', 1, 0), ('fee_only', 0, 1), ('both', 1, 1)) AS v(regime, ks, kf))
SELECT regime, count(*) AS n, avg(g) AS mean_gross, avg(net) AS mean_net, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit_rate, (SELECT count(DISTINCT CAST(event_time AS DATE)) FROM b) AS n_days FROM r GROUP BY regime""", "mean_gross mean_net hit_rate")
def book_cost_regimes(spark, sf):
    d = tk.trade_flow_features(ticks(spark, sf), horizons=(5,), windows=(1,), ties=["trade_id"])
    d = d.withColumns({"prediction": (F.col("trade_id") * 7919 % 1009 - 504) / 504.0 * 0.01, "mid_price": F.col("price"), "future_mid_price_5": (F.col("future_best_bid_5") + F.col("future_best_ask_5")) / 2})
    t = bt.book_trades(d.dropna(subset=["future_mid_return_5"]), 5, edge_multiple=2.0)
    n = t.agg(F.countDistinct(F.to_date("event_time")).alias("n_days"))
    r = bt.cost_regimes(t, {"no_cost": (0, 0), "spread_only": (1, 0), "fee_only": (0, 1), "both": (1, 1)})
    return r.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_return").alias("mean_gross"), F.avg("net_return").alias("mean_net"), F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate")).crossJoin(n)  # one-row side


@query("BT3", """WITH e AS (SELECT user_id AS symbol, CAST(epoch_us(ts) // 60000000 * 60 AS BIGINT) AS t, max(value) / 100 - 0.5 AS prediction, (max(event_id) % 21 - 10) * 0.001 AS target FROM events GROUP BY 1, 2), z AS (SELECT *, min(t) OVER () AS t0 FROM e), k AS (SELECT * FROM z WHERE abs(prediction) > 0.1 AND (t - t0) % 300 = 0)
SELECT t AS epoch_seconds, avg(CASE WHEN prediction > 0 THEN target ELSE -target END) AS gross_return, avg(CASE WHEN prediction > 0 THEN target ELSE -target END - 0.0012) AS net_return, count(*) AS n_trades FROM k GROUP BY t""", "gross_return net_return")
def horizon_portfolio(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("symbol"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60000000) * 60).alias("epoch_seconds")).agg(
        (F.max("value") / 100 - 0.5).alias("prediction"), ((F.max("event_id") % 21 - 10) * 0.001).alias("target"))
    return bt.horizon_portfolio(e, 0.1, 300, 5.0, 1.0)


@query("BT19 BT20 OS19 PT6", f"""WITH @bars, {SMOOTH}, r AS (SELECT *, coalesce(close / lag(close) OVER k - 1, 0) AS ret, coalesce(lag(signal, 1) OVER k, 0) AS p0, coalesce(lag(signal, 2) OVER k, 0) AS p1, coalesce(lag(signal, 3) OVER k, 0) AS p2 FROM sm WINDOW k AS (PARTITION BY symbol ORDER BY date)),
t AS (SELECT *, abs(p0 - coalesce(lag(p0) OVER k, 0)) AS t0, abs(p1 - coalesce(lag(p1) OVER k, 0)) AS t1, abs(p2 - coalesce(lag(p2) OVER k, 0)) AS t2 FROM r WINDOW k AS (PARTITION BY symbol ORDER BY date)),
v AS (SELECT 'base' AS variant, p0 * ret - t0 * 2e-4 AS n FROM t UNION ALL SELECT 'cost_x2', p0 * ret - t0 * 4e-4 FROM t UNION ALL SELECT 'cost_x3', p0 * ret - t0 * 6e-4 FROM t UNION ALL SELECT 'delay_1', p1 * ret - t1 * 2e-4 FROM t UNION ALL SELECT 'delay_2', p2 * ret - t2 * 2e-4 FROM t UNION ALL SELECT 'inverted', -p0 * ret - t0 * 2e-4 FROM t)
SELECT variant, count(*) AS n, sum(n) AS total, avg(n) / stddev_samp(n) * sqrt(252) AS sharpe FROM v GROUP BY variant""", "total sharpe", digits=5)
def stress_scenarios(spark, sf):
    d = smooth(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0)))
    return bt.stress(d).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("net_return").alias("total"), mt.sharpe("net_return").alias("sharpe"))


SENS_SQL = BOOK_SQL.replace("k AS (SELECT *, greatest(CAST(round_even(n * 0.1, 0) AS BIGINT), 1, 2) AS kk FROM r)",
                           "cb AS (SELECT q, gr, av FROM (SELECT unnest([0.05, 0.1]::DOUBLE[]) AS q), (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS gr), (SELECT unnest([0.01, 0.03]::DOUBLE[]) AS av)), k AS (SELECT *, greatest(CAST(round_even(n * q, 0) AS BIGINT), 1, 2) AS kk FROM r, cb)") \
    .replace("SELECT execution_date, symbol, close, open AS fill,", "SELECT q, gr, av, execution_date, symbol, close, open AS f1, (high + low + close) / 3 AS f2, close AS f3,").replace("least(500000.0 / kk, adv * 0.01, 50000.0)", "least(gr * 500000.0 / kk, adv * av, gr * 50000.0)") \
    .replace("SELECT execution_date, row_number() OVER (ORDER BY execution_date) AS no FROM (SELECT DISTINCT execution_date FROM bk)", "SELECT q, gr, av, execution_date, row_number() OVER (PARTITION BY q, gr, av ORDER BY execution_date) AS no FROM (SELECT DISTINCT q, gr, av, execution_date FROM bk)") \
    .replace("JOIN dy USING (execution_date)", "JOIN dy USING (q, gr, av, execution_date)").replace("SELECT coalesce(a.no, b.no + 1) AS no,", "SELECT coalesce(a.q, b.q) AS q, coalesce(a.gr, b.gr) AS gr, coalesce(a.av, b.av) AS av, coalesce(a.no, b.no + 1) AS no,").replace("a.fill,", "a.f1, a.f2, a.f3,") \
    .replace("ON a.no = b.no + 1 AND a.symbol = b.symbol", "ON a.q = b.q AND a.gr = b.gr AND a.av = b.av AND a.no = b.no + 1 AND a.symbol = b.symbol").replace("JOIN dy ON m.no = dy.no", "JOIN dy ON m.q = dy.q AND m.gr = dy.gr AND m.av = dy.av AND m.no = dy.no")


@query("BT20 BT7 BT8 BT10 BT11", f"""WITH @bars, {SENS_SQL}, d AS (SELECT q, gr, av, date, sum(CASE WHEN sp <> 0 AND cp IS NOT NULL AND ct IS NOT NULL THEN sp * (ct / cp - 1) ELSE 0 END) - sum(abs(sn - sp)) * 0.5e-4 - sum(abs(sn - sp) * 15 * CASE WHEN isnew AND date < DATE '2001-04-09' THEN 2.5 ELSE 1 END / 2 / 1e4) - greatest(sum(abs(sn)) - 1e6, 0) * 0.05 / 252 AS fx,
 coalesce(sum(CASE WHEN sn <> sp THEN (sn - sp) / f1 * (ct - f1) END), 0) AS l1, coalesce(sum(CASE WHEN sn <> sp THEN (sn - sp) / f2 * (ct - f2) END), 0) AS l2, coalesce(sum(CASE WHEN sn <> sp THEN (sn - sp) / f3 * (ct - f3) END), 0) AS l3, sum(CASE WHEN sn < 0 THEN -sn * 100 / 1e4 / 252 ELSE 0 END) AS bo FROM m2 GROUP BY 1, 2, 3, 4)
SELECT b AS borrow_multiplier, f AS fill_model, q AS q_quantile, gr AS target_gross, av AS adv_participation_pct, count(*) AS n_days, avg(fx + CASE f WHEN 'open' THEN l1 WHEN 'hlc3' THEN l2 ELSE l3 END - b * bo) AS mean_daily_net
FROM d, (SELECT unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS b), (SELECT unnest(['open', 'hlc3', 'close']) AS f) GROUP BY 1, 2, 3, 4, 5""", "mean_daily_net", digits=4)
def sensitivity_audit(spark, sf):
    return bt.book_sensitivity(book_panel(spark, sf), bt.sensitivity_cases(audit=True), min_names=2)


@query("BT21", f"""WITH @bars, {SMOOTH}, r AS (SELECT symbol, date, coalesce(close / lag(close) OVER k - 1, 0) AS ret, CASE WHEN signal > 0 THEN 1.0 ELSE 0.0 END AS pos FROM sm WINDOW k AS (PARTITION BY symbol ORDER BY date)), f AS (SELECT *, coalesce(lag(pos) OVER k, 0) AS pv, coalesce(product(1 + ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) - 1, 0) AS nx FROM r WINDOW k AS (PARTITION BY symbol ORDER BY date)),
c AS (SELECT symbol, quantile_cont(ret, 0.05) AS cut FROM r GROUP BY symbol), w AS (SELECT r.symbol, count(*) AS n_worst_days, avg(CASE WHEN pos = 0 THEN 1.0 ELSE 0 END) AS avoided_share, sum(pos * ret) AS pnl_on_worst FROM r JOIN c USING (symbol) WHERE ret <= cut GROUP BY 1)
SELECT f.symbol, count_if(pos <> pv) AS n_flips, avg(CASE WHEN pos > 0 THEN 1.0 ELSE 0 END) AS exposure, count_if(pv = 0 AND pos > 0) AS n_entries, avg(CASE WHEN pv = 0 AND pos > 0 THEN nx END) AS mean_return_after_entry, any_value(n_worst_days) AS n_worst_days, any_value(avoided_share) AS avoided_share, any_value(pnl_on_worst) AS pnl_on_worst
FROM f JOIN w ON f.symbol = w.symbol GROUP BY f.symbol""", "exposure mean_return_after_entry avoided_share pnl_on_worst")
def robustness_diagnostics(spark, sf):
    d = smooth(spark, sf).withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1, F.lit(0.0))).withColumn("position", F.when(F.col("signal") > 0, 1.0).otherwise(0.0))
    return bt.flip_diagnostics(d).join(bt.crash_protection(d).drop("underlying_on_worst"), "symbol")


@query("BT22 BT23 AG14 MT12", f"""WITH @bars, {SMOOTH}, {SA}, d AS (SELECT symbol % 4 AS strategy, date, avg(net) AS net FROM sa GROUP BY 1, 2), w AS (SELECT * FROM d, (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'), ('mid', DATE '1997-01-01', DATE '1999-06-30'), ('overlap', DATE '1996-06-01', DATE '1998-06-30')) AS v(label, lo, hi) WHERE date BETWEEN lo AND hi)
SELECT strategy, label, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, product(1 + net) - 1 AS total_return, count(*) AS n_days FROM w GROUP BY 1, 2""", "sharpe total_return")
def window_report(spark, sf):
    d = bt.single_asset(smooth(spark, sf)).groupBy((F.col("symbol") % 4).alias("strategy"), "date").agg(F.avg("net_return").alias("net_return"))
    w = bt.window_report(d, [("early", "1995-01-01", "1996-12-31"), ("mid", "1997-01-01", "1999-06-30"), ("overlap", "1996-06-01", "1998-06-30")])
    return w.select("strategy", "label", "sharpe", "total_return", "n_days")


@query("RK8", """WITH @bars, a AS (SELECT symbol, date, close / open - 1 AS p, (lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1) * 0.01 AS y FROM bars), c AS (SELECT * FROM a WHERE y IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY -p, symbol) AS rk, count(*) OVER (PARTITION BY date) AS n FROM c), dd AS (SELECT date, n, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT date, count(*) AS n FROM c GROUP BY date)),
u AS (SELECT date, last_value(CASE WHEN i % 5 = 0 OR rn = 1 THEN date END IGNORE NULLS) OVER (ORDER BY date) AS refresh FROM (SELECT *, row_number() OVER (ORDER BY date) AS rn FROM dd WHERE n >= 2)),
s AS (SELECT symbol, date AS refresh, CASE WHEN rk <= m THEN 1 WHEN rk > n - m THEN -1 END AS side FROM (SELECT *, least(greatest(CAST(floor(n * 0.2) AS BIGINT), 1), greatest(n // 2, 1)) AS m FROM r)),
l AS (SELECT c.date, u.refresh, count_if(side = 1) AS long_count, count_if(side = -1) AS short_count, avg(CASE WHEN side = 1 THEN y END) AS lm, avg(CASE WHEN side = -1 THEN y END) AS sm FROM c JOIN u ON c.date = u.date JOIN s ON s.symbol = c.symbol AND s.refresh = u.refresh WHERE side IS NOT NULL GROUP BY 1, 2),
o AS (SELECT date, long_count, short_count, CAST(date = refresh AS INTEGER) AS rebalanced, 0.5 * lm - 0.5 * sm AS gross_return, 0.5 * lm - 0.5 * sm - CASE WHEN date = refresh THEN 2 ELSE 0 END * 5e-4 AS net_return FROM l WHERE long_count > 0 AND short_count > 0)
SELECT *, product(1 + net_return) OVER (ORDER BY date) AS equity FROM o""", "gross_return net_return equity")
def refreshed_long_short(spark, sf):
    d = bars(spark, sf).select("symbol", "date", (F.col("close") / F.col("open") - 1).alias("p"), ((div(F.lead("close").over(by()), "close") - 1) * 0.01).alias("y")).filter("y IS NOT NULL")
    return bt.refreshed_long_short(d, "p", "y", every=5, fraction=0.2).select("date", "long_count", "short_count", "rebalanced", "gross_return", "net_return", "equity")


@query("RK9 PRJ3", """WITH @scored, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY -pred, row_id, y, w) AS rk, count(*) OVER (PARTITION BY date) AS n FROM scored), k AS (SELECT *, least(greatest(CAST(floor(n * 0.1) AS BIGINT), 1), greatest(n // 2, 1)) AS m FROM r WHERE n >= 2),
g AS (SELECT date, count_if(rk <= m) AS long_count, count_if(rk > n - m) AS short_count, sum(CASE WHEN rk <= m THEN w * y END) / sum(CASE WHEN rk <= m THEN w END) AS long_capture, sum(CASE WHEN rk > n - m THEN w * y END) / sum(CASE WHEN rk > n - m THEN w END) AS short_capture FROM k GROUP BY date)
SELECT *, 0.5 * (long_capture - short_capture) AS pnl_units, sum(0.5 * (long_capture - short_capture)) OVER (ORDER BY date) AS cumulative_pnl_units FROM g""", "long_capture short_capture pnl_units cumulative_pnl_units")
def grouped_long_short(spark, sf):
    return bt.grouped_long_short(scored(spark, sf), "pred", "y", "w", ties=("row_id", "y", "w"))


@query("MT4 MT5 MT6 MT7 MT11", """WITH @scored SELECT symbol % 10 AS grp, count(*) AS rows, 1 - sum(w * (y - pred) ** 2) / sum(w * y * y) AS weighted_r2, 1 - sum((y - pred) ** 2) / sum(y * y) AS r2, corr(y, pred) AS ic,
 (sum(w * y * pred) / sum(w) - sum(w * y) / sum(w) * sum(w * pred) / sum(w)) / sqrt((sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2) * (sum(w * pred * pred) / sum(w) - (sum(w * pred) / sum(w)) ** 2)) AS weighted_ic,
 avg(CASE WHEN (y > 0) = (pred > 0) THEN 1.0 ELSE 0 END) AS acc_positive, avg(CASE WHEN y <> 0 THEN CASE WHEN sign(y) = sign(pred) THEN 1.0 ELSE 0 END END) AS acc_sign, avg(CASE WHEN y <> 0 AND pred <> 0 THEN CASE WHEN sign(y) = sign(pred) THEN 1.0 ELSE 0 END END) AS acc_nonzero,
 sum(CASE WHEN y <> 0 AND sign(y) = sign(pred) THEN w ELSE 0 END) / sum(CASE WHEN y <> 0 THEN w ELSE 0 END) AS weighted_accuracy, sum(w * sign(pred) * y) / sum(w) AS sign_capture, avg(CASE WHEN pred > 0 THEN CASE WHEN y > 0 THEN 1.0 ELSE 0 END END) AS precision_positive,
 avg(CASE WHEN pred < 0 THEN CASE WHEN y < 0 THEN 1.0 ELSE 0 END END) AS precision_negative FROM scored GROUP BY 1""",
       "weighted_r2 r2 ic weighted_ic acc_positive acc_sign acc_nonzero weighted_accuracy sign_capture precision_positive precision_negative")
def prediction_metrics(spark, sf):
    return mt.prediction_metrics(scored(spark, sf).withColumn("grp", F.col("symbol") % 10), "y", "pred", "w", ["grp"])


@query("MT8", f"""WITH @bars, {SMOOTH}, {SA}, d AS (SELECT symbol % 10 AS grp, date, avg(net) AS x FROM sa GROUP BY 1, 2), an AS (SELECT date, avg(ur) AS b FROM sa GROUP BY 1), j AS (SELECT * FROM d JOIN an USING (date)), f AS (SELECT grp, regr_slope(x, b) AS s FROM j GROUP BY grp)
SELECT j.grp, count(*) AS n, corr(x, b) AS correlation, (avg(x) / stddev_samp(x) - avg(b) / stddev_samp(b)) * sqrt(252) AS incremental_sharpe, any_value(s) AS beta, avg(x - s * b) / stddev_samp(x - s * b) * sqrt(252) AS residual_sharpe FROM j JOIN f ON j.grp = f.grp GROUP BY j.grp""",
       "correlation incremental_sharpe beta residual_sharpe")
def attribution(spark, sf):
    sa = bt.single_asset(smooth(spark, sf))
    d = sa.groupBy((F.col("symbol") % 10).alias("grp"), "date").agg(F.avg("net_return").alias("x"))
    return mt.attribution(d.join(F.broadcast(sa.groupBy("date").agg(F.avg("underlying_return").alias("b"))), "date"), "x", "b", ["grp"])


@query("MT9 MT12 MT2", f"""WITH @bars, {SMOOTH}, {SA}, d AS (SELECT date, avg(net) AS x, CASE WHEN month(date) % 3 = 0 THEN 'stress' WHEN month(date) % 3 = 1 THEN 'calm' ELSE 'mixed' END AS regime FROM sa GROUP BY 1),
m AS (SELECT regime, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe, product(1 + x) - 1 AS total_return, power(product(1 + x), 252.0 / count(*)) - 1 AS annualized_return, avg(CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN 0 END) AS hit_rate, count(*) AS n_days FROM d GROUP BY regime)
SELECT m.*, max_drawdown, CASE WHEN max_drawdown < 0 THEN annualized_return / abs(max_drawdown) ELSE 0 END AS calmar FROM m JOIN {dd_sql('d', 'x', 'regime')} k ON m.regime = k.regime""", "sharpe total_return annualized_return hit_rate max_drawdown calmar")
def regime_metrics(spark, sf):
    d = bt.single_asset(smooth(spark, sf)).groupBy("date").agg(F.avg("net_return").alias("x"))
    m = F.month("date") % 3
    d = d.withColumn("regime", F.when(m == 0, "stress").when(m == 1, "calm").otherwise("mixed"))
    return mt.regime_metrics(d, "x", "regime").drop("sortino")


@query("MT10", """WITH c AS (SELECT CAST(l_quantity AS INTEGER) % 5 AS a, CAST(l_discount * 100 AS INTEGER) % 5 AS p, count(*) AS o FROM lineitem GROUP BY 1, 2), ra AS (SELECT a, sum(o) AS r FROM c GROUP BY a), cp AS (SELECT p, sum(o) AS k FROM c GROUP BY p)
SELECT CAST(sum(o) AS BIGINT) AS rows, sum(abs(a - p) * o) / sum(o) AS mae, sqrt(sum((a - p) ** 2 * o) / sum(o)) AS rmse, sum(CASE WHEN a = p THEN o ELSE 0 END) / sum(o) AS accuracy, sum(CASE WHEN abs(a - p) <= 1 THEN o ELSE 0 END) / sum(o) AS within_one,
 1 - sum((a - p) ** 2 * o) * sum(o) / (SELECT sum((a - p) ** 2 * r * k) FROM ra, cp) AS quadratic_kappa, (SELECT avg(x / r) FROM (SELECT a, sum(CASE WHEN a = p THEN o ELSE 0 END) AS x, sum(o) AS r FROM c GROUP BY a)) AS macro_recall FROM c""",
       "mae rmse accuracy within_one quadratic_kappa macro_recall")
def class_metrics(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_quantity").cast("int") % 5).alias("a"), (F.round(F.col("l_discount") * 100).cast("int") % 5).alias("p"))
    return mt.class_metrics(d, "a", "p", 5)


@query("MT13 MT14", """WITH f AS (SELECT user_id AS symbol, ts, event_id, value AS price, event_type IN ('view', 'click') AS b, row_number() OVER w AS rn, lag(value) OVER w AS op, lag(event_type IN ('view', 'click')) OVER w AS ob FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT avg(CASE WHEN (price - op) * CASE WHEN ob THEN 1 ELSE -1 END > 0 THEN 1.0 ELSE 0 END) AS hit_rate, count(*) AS n_round_trips FROM f WHERE rn % 2 = 0""", "hit_rate")
def round_trip_hits(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), F.when(F.col("event_type").isin("view", "click"), "buy").otherwise("sell").alias("side"))
    return mt.round_trip_hits(e, ties=("event_id",))
