"""Cost, position and back-test tables as window queries over a fixed signal."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import by, clip, code_map, div, so_far
from quantloom.operators import metrics as mt
from quantloom.operators.quantiles import exact_quantiles
from quantloom.operators.ranks import ordinal
from quantloom.session import by_key, stored


def execution_filters(df: DataFrame, min_abs_signal: float, max_relative_spread: float, min_depth: float, edge_multiple: float) -> DataFrame:
    """Signal strength, spread, depth at the touch and edge over cost, as one filter."""
    return df.filter((F.abs("signal") >= min_abs_signal) & (F.col("relative_spread") <= max_relative_spread) & (F.col("depth") >= min_depth)
                     & (F.col("edge") >= edge_multiple * F.col("cost")))


def winsorise(df: DataFrame, columns: Sequence[str], low: float, high: float, min_rows: int = 10) -> DataFrame:
    """Clip columns at full-sample quantiles; a column with fewer than ``min_rows`` finite values stays."""
    d = df
    for c in columns:
        d = d.crossJoin(F.broadcast(exact_quantiles(df, c, [low, high], name=f"_q_{c}").withColumnRenamed("n", f"_n_{c}")))  # one-row side
    out = {c: F.when((F.col(f"_n_{c}") >= min_rows) & F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1])).otherwise(F.col(c)) for c in columns}
    return d.withColumns(out).drop(*[f"_{k}_{c}" for c in columns for k in "qn"])


def tercile(df: DataFrame, x: str, name: str, labels: tuple[str, str, str]) -> DataFrame:
    q = exact_quantiles(df, x, [1 / 3, 2 / 3], name="_t").drop("n")
    d = df.crossJoin(F.broadcast(q))  # one-row side
    return d.withColumn(name, F.when(F.col(x) <= F.col("_t")[0], labels[0]).when(F.col(x) <= F.col("_t")[1], labels[1]).otherwise(labels[2])).drop("_t")


# ---------------------------------------------------------------- costs

# Borrow cost by tier (annual bp), spread fallback by tier (bp), thresholds of the hard tier.
BORROW_BPS = {"easy": 25.0, "general": 100.0, "hard": 500.0}
SPREAD_BPS = {"easy": 5.0, "general": 15.0, "hard": 50.0}
DECIMALISATION = "2001-04-09"


def fill_price(model: str) -> Column:
    return {"open": F.col("open"), "hlc3": (F.col("high") + F.col("low") + F.col("close")) / 3.0, "close": F.col("close")}[model]


def commission(notional: Column, bps: float = 0.5) -> Column:
    return notional * (bps / 1e4)


def half_spread_cost(notional: Column, roll_bps: Column, tier: Column, date: Column, cap: float = 50.0, fallback_mult: float = 2.5, roll_mult: float = 1.5) -> Column:
    """Half of the capped Roll spread, or of the tier fallback, wider before decimalisation (an unknown date is not)."""
    raw = F.when(roll_bps.isNotNull(), F.least(roll_bps, F.lit(cap))).otherwise(
        F.when(tier == "easy", SPREAD_BPS["easy"]).when(tier == "hard", SPREAD_BPS["hard"]).otherwise(SPREAD_BPS["general"]))
    mult = F.when(date < F.lit(DECIMALISATION).cast("date"), F.when(roll_bps.isNotNull(), roll_mult).otherwise(fallback_mult)).otherwise(1.0)
    return notional * raw * mult / 2.0 / 1e4


def borrow_tier(on: Column, ipo: Column, adv: Column, vol: Column, price: Column, recent_addition: Column, short_interest: Column, manual_hard: Column) -> Column:
    """Hard to borrow by override, recent listing, low liquidity, high volatility, low price, high short interest or a weak new addition."""
    tests = [manual_hard, F.datediff(on, ipo) < 183, adv < 5e6, vol > 0.80, price < 5.0, short_interest > 0.10,
             recent_addition & (F.coalesce(adv < 1e7, F.lit(False)) | F.coalesce(vol > 0.40, F.lit(False)))]
    hard = F.lit(False)
    for t in tests:
        hard = hard | F.coalesce(t, F.lit(False))
    return F.when(hard, "hard").otherwise("general")


def borrow_cost(signed: Column, tier: Column, multiplier: float = 1.0) -> Column:
    """Daily charge on short notional."""
    bps = F.when(tier == "easy", BORROW_BPS["easy"]).when(tier == "hard", BORROW_BPS["hard"]).otherwise(BORROW_BPS["general"])
    return F.when(signed < 0, -signed * bps * multiplier / 1e4 / 252.0).otherwise(0.0)


def financing_cost(gross: Column, equity: float, rate: float) -> Column:
    return F.greatest(gross - equity, F.lit(0.0)) * rate / 252.0


def position_price_pnl(held: DataFrame, new_lots: DataFrame) -> DataFrame:
    """Price P&L of held positions and of new lots, one row per position."""
    a = held.select("date", "symbol", (F.col("signed_notional_prev") * (F.col("close_today") / F.col("close_prev") - 1.0)).alias("price_pnl"))
    b = new_lots.select("date", "symbol", (F.col("signed_notional_new") / F.col("fill_price") * (F.col("close_today") - F.col("fill_price"))).alias("price_pnl"))
    return a.unionByName(b)


def cash_dividend_pnl(positions: DataFrame, dividends: DataFrame) -> DataFrame:
    """Longs receive and shorts pay the dividend on shares at the reference close."""
    d = positions.join(dividends.withColumnRenamed("ex_date", "date"), ["symbol", "date"])
    return d.select("date", "symbol", (F.col("signed_notional") / F.col("ref_close") * F.col("dividend_per_share")).alias("cash_dividend_pnl"))


# ---------------------------------------------------------------- single asset and timing

def single_asset(df: DataFrame, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), signal: str = "signal", one_way_bps: float = 1.5,
                 clip_to: float | None = 1.0, close: str = "close") -> DataFrame:
    """Daily table: today's position is yesterday's clipped signal; cost on the change of position."""
    w = by(key, time)
    s = F.coalesce(F.nanvl(F.col(signal).cast("double"), F.lit(0.0)), F.lit(0.0))
    s = clip(s, -clip_to, clip_to) if clip_to else s
    d = df.withColumns({"_s": s, "underlying_return": F.coalesce(div(close, F.lag(close).over(w)) - 1.0, F.lit(0.0))})
    d = d.withColumn("position", F.coalesce(F.lag("_s").over(w), F.lit(0.0)))
    d = d.withColumns({"gross_return": F.col("position") * F.col("underlying_return"), "turnover": F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))})
    d = d.withColumn("cost", F.col("turnover") * (one_way_bps / 1e4))
    return d.withColumn("net_return", F.col("gross_return") - F.col("cost")).drop("_s")


def single_asset_summary(daily: DataFrame, keys: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    m = mt.daily_metrics(daily, "net_return", keys, date).select(*keys, "sharpe", "sortino", "total_return", "max_drawdown", "hit_rate")
    t = daily.groupBy(*keys).agg(F.count_if(F.col("turnover") > 1e-12).alias("n_trades"), F.avg(F.abs("position")).alias("avg_position"),
                                 (F.sum("turnover") * 252 / F.count(F.lit(1))).alias("annual_turnover"))
    return m.join(t, list(keys))


def timing(df: DataFrame, ret: str = "ret", signal: str = "signal", key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), round_trip_bps: float = 2.0, delay: int = 0) -> DataFrame:
    """Lagged signal times return less the cost of the change."""
    w = by(key, time)
    d = df.withColumn("position", F.coalesce(F.lag(signal, 1 + delay).over(w), F.lit(0.0)))
    d = d.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    return d.withColumn("net_return", F.col("position") * F.col(ret) - F.col("turnover") * (round_trip_bps / 1e4))


def held_positions(df: DataFrame, position: str = "position", ret: str = "ret", key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), bps: float = 1.0, delay: int = 0) -> DataFrame:
    """P&L of given positions; the first row's position is not charged as a change."""
    w = by(key, time)
    d = df.withColumn("_p", F.coalesce(F.lag(position, delay).over(w), F.lit(0.0)) if delay else F.col(position))
    d = d.withColumn("turnover", F.abs(F.col("_p") - F.coalesce(F.lag("_p").over(w), F.col("_p"))))
    return d.withColumn("net_return", F.col("_p") * F.col(ret) - F.col("turnover") * (bps / 1e4)).drop("_p")


def long_or_cash(df: DataFrame, rates: DataFrame, signal: str = "signal", ret: str = "ret", bps: float = 1.0) -> DataFrame:
    """Invested when the lagged signal is on, else in cash, under three cash assumptions (rows ``assumption``)."""
    from quantloom.operators.joins import cash_yield
    dates = df.select("date").distinct()
    cash = None
    for a in ("zero", "tbill", "tbill_minus_25bps"):
        c = cash_yield(dates, rates, a).withColumn("assumption", F.lit(a))
        cash = c if cash is None else cash.unionByName(c)
    w = by()
    d = df.withColumn("_on", F.coalesce(F.lag(signal).over(w), F.lit(0.0)))
    d = d.withColumn("_turn", F.abs(F.col("_on") - F.coalesce(F.lag("_on").over(w), F.lit(0.0))))
    d = d.join(F.broadcast(cash), "date")  # three rows per date, calendar-sized
    return d.withColumn("net_return", F.col("_on") * F.col(ret) + (1.0 - F.col("_on")) * F.col("cash_yield") - F.col("_turn") * (bps / 1e4)).drop("_on", "_turn")


def allocator(weights: DataFrame, cost_bps: dict[str, float] | float = 5.0, weight: str = "weight", ret: str = "ret", key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Portfolio P&L of lagged weights across instruments with per-name costs, summed by date."""
    w = by(key)
    d = weights.withColumn("_w", F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    d = d.withColumn("_t", F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(w), F.lit(0.0))))
    bps = F.lit(float(cost_bps)) if not isinstance(cost_bps, dict) else code_map(F.col(key[0]).cast("string"), cost_bps, 5.0)
    return d.groupBy("date").agg(F.sum(F.col("_w") * F.col(ret)).alias("gross_return"), F.sum(F.col("_t") * bps / 1e4).alias("cost"), F.sum("_t").alias("turnover")).withColumn(
        "net_return", F.col("gross_return") - F.col("cost"))


# ---------------------------------------------------------------- bars with scores

def bar_backtest(df: DataFrame, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), position: str = "raw_position", delay: int = 0, cost: float = 0.0005, horizon: int = 1) -> DataFrame:
    """Per-bar P&L of a delayed position and, on bars that trade, the audit of the mid exit ``horizon`` bars later.

    Near the end the exit is the last bar of the series.
    """
    w = by(key, time)
    d = df.withColumns({"pos": F.coalesce(F.lag(position, delay).over(w), F.lit(0.0)) if delay else F.col(position),
                        "bar_return": F.coalesce(div("close", F.lag("close").over(w)) - 1.0, F.lit(0.0))})
    d = d.withColumn("position", F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    d = d.withColumn("turnover", F.abs(F.col("pos") - F.col("position")))
    last = F.last("close").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumns({"gross_return": F.col("position") * F.col("bar_return"), "cost_return": F.col("turnover") * cost,
                       "exit_mid": F.coalesce(F.lead("close", max(horizon, 1)).over(w), last)})
    d = d.withColumn("net_return", F.col("gross_return") - F.col("cost_return"))
    return d.withColumns({"equity": F.product(1.0 + F.col("net_return")).over(so_far(key, time)), "side": F.when(F.col("pos") > 0, "long").when(F.col("pos") < 0, "short").otherwise("flat"),
                          "realized_mid_return": F.signum("pos") * (F.col("exit_mid") / F.greatest("close", F.lit(1e-12)) - 1.0),
                          "is_trade": F.col("turnover") > 0}).drop("exit_mid")


def horizon_portfolio(df: DataFrame, threshold: float, horizon_seconds: int, fee_bps: float, slippage_bps: float, side: str = "both", cost_multiplier: float = 1.0,
                      prediction: str = "prediction", target: str = "target", time: str = "epoch_seconds") -> DataFrame:
    """Trades on the non-overlapping bars (t - t0) % horizon = 0, then the mean across assets per timestamp."""
    clean = df.dropna(subset=[prediction, target])
    t0 = clean.agg(F.min(time).alias("_t0"))
    sides = {"both": F.lit(True), "long_only": F.col(prediction) > 0, "short_only": F.col(prediction) <= 0}[side]
    cost = 2.0 * (fee_bps + slippage_bps) * 1e-4 * cost_multiplier
    d = clean.crossJoin(F.broadcast(t0)).filter((F.abs(prediction) > threshold) & sides & ((F.col(time) - F.col("_t0")) % horizon_seconds == 0))  # one-row side
    d = d.withColumn("gross_return", F.when(F.col(prediction) > 0, F.col(target)).otherwise(-F.col(target)))
    return d.groupBy(time).agg(F.avg("gross_return").alias("gross_return"), F.avg(F.col("gross_return") - cost).alias("net_return"), F.count(F.lit(1)).alias("n_trades"))


def taker_trades(df: DataFrame, horizon: int, fee_bps: float = 0.0, slippage_bps: float = 0.0, cost_multiplier: float = 1.0, invert: bool = False, min_signal_abs: float = 0.0,
                 max_relative_spread: float | None = None, min_depth: float | None = None, edge_multiple: float | None = None, prediction: str = "prediction") -> DataFrame:
    """Taker trades at the touch: longs buy the ask and sell the future bid, shorts the reverse.

    Latency in events is a lag of the prediction taken with the features (see the tick blocks).
    """
    cost = 2.0 * (fee_bps + slippage_bps) * 1e-4 * cost_multiplier
    bid, ask = f"future_best_bid_{horizon}", f"future_best_ask_{horizon}"
    d = df.withColumn("_p", -F.col(prediction) if invert else F.col(prediction)).withColumn("top_of_book_depth", F.least("best_bid_size", "best_ask_size"))
    d = d.dropna(subset=["_p", "best_bid", "best_ask", bid, ask]).filter((F.abs("_p") > min_signal_abs) & (F.col("_p") != 0))
    if max_relative_spread is not None:
        d = d.filter(F.col("relative_spread") <= max_relative_spread)
    if min_depth is not None:
        d = d.filter(F.col("top_of_book_depth") >= min_depth)
    if edge_multiple is not None and cost > 0:
        d = d.filter(F.abs("_p") >= edge_multiple * cost)
    long = F.col("_p") > 0
    gross = F.when(long, F.col(bid) / F.col("best_ask") - 1.0).otherwise(F.col("best_bid") / F.col(ask) - 1.0)
    return d.withColumns({"side": F.when(long, "long").otherwise("short"), "entry_price": F.when(long, F.col("best_ask")).otherwise(F.col("best_bid")),
                          "exit_price": F.when(long, F.col(bid)).otherwise(F.col(ask)), "gross_return": gross, "cost_return": F.lit(cost), "net_return": gross - cost}).drop("_p")


def book_trades(df: DataFrame, horizon: int, fee_bps: float = 0.5, slippage_bps: float = 0.5, spread_multiplier: float = 1.0, min_signal_abs: float = 0.0,
                edge_multiple: float | None = None, invert: bool = False, prediction: str = "prediction") -> DataFrame:
    """L2 trades: mid return of the side less spread from prices, fee and slippage."""
    s = -F.col(prediction) if invert else F.col(prediction)
    d = df.withColumn("_s", s).filter((F.abs("_s") >= min_signal_abs) & (F.col("_s") != 0))
    side = F.when(F.col("_s") > 0, 1.0).otherwise(-1.0)
    entry_half, exit_half = (F.col("best_ask") - F.col("best_bid")) / 2.0, (F.col(f"future_best_ask_{horizon}") - F.col(f"future_best_bid_{horizon}")) / 2.0
    priced = div(entry_half, "mid_price") + div(exit_half, f"future_mid_price_{horizon}")
    d = d.withColumns({"position_side": side, "spread_cost": F.coalesce(priced, F.col("relative_spread")) * spread_multiplier,
                       "fee_cost": F.lit(2 * fee_bps * 1e-4), "slippage_cost": F.lit(2 * slippage_bps * 1e-4)})
    d = d.withColumn("cost_return", F.col("spread_cost") + F.col("fee_cost") + F.col("slippage_cost"))
    if edge_multiple is not None:
        d = d.filter(F.abs("_s") >= edge_multiple * F.col("cost_return"))
    d = d.withColumn("gross_return", F.col("position_side") * F.col(f"future_mid_return_{horizon}"))
    return d.withColumns({"net_return": F.col("gross_return") - F.col("cost_return"), "side": F.when(F.col("position_side") > 0, "long").otherwise("short")}).drop("_s")


def cost_regimes(trades: DataFrame, regimes: dict[str, tuple[float, float]]) -> DataFrame:
    """Re-price trades under named (spread, fee) multipliers in one pass over the trades."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.lit(float(a)).alias("ks"), F.lit(float(b)).alias("kf")) for n, (a, b) in regimes.items()]))
    d = trades.withColumn("_r", rows)
    return d.withColumn("regime", F.col("_r.regime")).withColumn(
        "net_return", F.col("gross_return") - F.col("_r.ks") * F.col("spread_cost") - F.col("_r.kf") * (F.col("fee_cost") + F.col("slippage_cost"))).drop("_r")


# ---------------------------------------------------------------- cross-sectional book

def target_book(signals: DataFrame, q: float, target_gross: float, equity: float, min_names: int = 5, adv_pct: float = 0.01, name_cap: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Top and bottom names per execution date (and ``keys``) with capped equal sizes; a date that cannot fill both sides has no book."""
    ok = signals.filter(F.col("tradable") & F.col("in_pit_universe"))
    r = ordinal(ok, "y_xs_pred", "_r", (*keys, "execution_date"), ("symbol",), size="_n")
    k = F.greatest(F.greatest(F.bround(F.col("_n") * q), F.lit(1)), F.lit(min_names)).cast("long")
    r = r.withColumn("_k", k).filter(2 * F.col("_k") <= F.col("_n"))
    gross = target_gross * equity
    size = F.least(F.lit(gross / 2.0) / F.col("_k"), F.col("adv_20d_dollar_lag1") * adv_pct, F.lit(gross * name_cap))
    side = F.when(F.col("_r") > F.col("_n") - F.col("_k"), 1.0).when(F.col("_r") <= F.col("_k"), -1.0)
    return r.withColumn("signed_target_notional", side * size).filter(side.isNotNull()).drop("_r", "_n", "_k")


def book_inputs(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns of a panel that a book reads, written once: ranks, books and closes read them several times, and the bars and windows behind them are made once."""
    return stored(panel.select(*keys, "execution_date", "symbol", "open", "high", "low", "close", "y_xs_pred", "adv_20d_dollar_lag1", "tradable", "in_pit_universe", "borrow_tier", "roll_spread_bps"))


def book_backtest(panel: DataFrame, q: float = 0.1, target_gross: float = 1.0, equity: float = 1e6, min_names: int = 5, fill: str = "open", borrow_multiplier: float = 1.0,
                  financing_rate: float = 0.05, commission_bps: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Daily P&L of the cross-sectional book: held and new-lot P&L, commission, spread, borrow, financing.

    The previous book is the last non-empty one.  Equity is constant, so no day depends on the P&L of
    an earlier one: books are numbered, each is met with its successor by (symbol, number), and all
    days are computed at once.  A name that leaves has no tier, fill or date in the new book: it pays
    the general spread without the pre-decimalisation factor and earns no new-lot P&L.  ``keys`` (a sector, constant
    per symbol) run one book each in the same plan.
    """
    panel = book_inputs(panel, keys)
    book = stored(target_book(panel, q, target_gross, equity, min_names, keys=keys).select(
        *keys, "execution_date", "symbol", F.col("signed_target_notional").alias("signed"), F.col("borrow_tier").alias("tier"), "roll_spread_bps", "close", fill_price(fill).alias("fill")))
    days = book.select(*keys, "execution_date").distinct().withColumn("book_no", F.row_number().over(W.partitionBy(*keys).orderBy("execution_date")))  # one row per date
    book = book.join(F.broadcast(days), [*keys, "execution_date"])
    closes = panel.select("execution_date", "symbol", F.col("close").alias("close_today"))
    new = book.select(*keys, "book_no", "symbol", F.col("signed").alias("signed_new"), "tier", "roll_spread_bps", "fill", F.lit(True).alias("_new"))
    prev = book.select(*keys, (F.col("book_no") + 1).alias("book_no"), "symbol", F.col("signed").alias("signed_prev"), F.col("close").alias("close_prev"))
    m = new.join(prev, [*keys, "book_no", "symbol"], "full").join(F.broadcast(days), [*keys, "book_no"]).join(closes, ["execution_date", "symbol"], "left")
    m = m.withColumns({"signed_new": F.coalesce("signed_new", F.lit(0.0)), "signed_prev": F.coalesce("signed_prev", F.lit(0.0))})
    change = F.col("signed_new") - F.col("signed_prev")
    held_pnl = F.when(F.col("signed_prev") != 0, F.col("signed_prev") * (F.col("close_today") / F.col("close_prev") - 1.0))
    lot_pnl = F.when(change != 0, change / F.col("fill") * (F.col("close_today") - F.col("fill")))
    date = F.when(F.col("_new"), F.col("execution_date"))
    d = m.groupBy(*keys, "execution_date").agg(
        (F.coalesce(F.sum(held_pnl), F.lit(0.0)) + F.coalesce(F.sum(lot_pnl), F.lit(0.0))).alias("price_pnl"), F.sum(commission(F.abs(change), commission_bps)).alias("commission_drag"),
        F.sum(half_spread_cost(F.abs(change), F.col("roll_spread_bps"), F.coalesce("tier", F.lit("general")), date)).alias("spread_drag"),
        F.sum(borrow_cost(F.col("signed_new"), F.col("tier"), borrow_multiplier)).alias("borrow_drag"), F.sum(F.abs("signed_new")).alias("gross_notional"),
        F.sum("signed_new").alias("net_notional"), F.sum(F.abs(change)).alias("traded"))
    d = d.withColumn("financing_drag", financing_cost(F.col("gross_notional"), equity, financing_rate))
    net = F.col("price_pnl") - F.col("commission_drag") - F.col("spread_drag") - F.col("borrow_drag") - F.col("financing_drag")
    return d.withColumnRenamed("execution_date", "date").withColumns({"gross_return": F.col("price_pnl") / equity, "net_return": net / equity})


# ---------------------------------------------------------------- carry

def carry(panel: DataFrame, spot_bps: float = 10.0, perp_bps: float = 5.0, slip_bps: float = 0.0, rebalance: bool = True, invert: bool = False, zero_funding: bool = False,
          key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Delta-neutral carry: price + funding − cost of entry, exit and hedge turnover; ``invert``/``zero_funding`` are placebos."""
    w = by(key, time)
    rate = (spot_bps + perp_bps) * 1e-4 + 2.0 * slip_bps * 1e-4
    first, last = F.lag("spot").over(w).isNull(), F.lead("spot").over(w).isNull()
    price = F.coalesce(div("spot", F.lag("spot").over(w)) - 1.0, F.lit(0.0)) - F.coalesce(div("perp", F.lag("perp").over(w)) - 1.0, F.lit(0.0))
    fund = F.lit(0.0) if zero_funding else F.when(first, 0.0).otherwise(F.col("funding"))
    sgn = -1.0 if invert else 1.0
    d = panel.withColumns({"_first": first, "_last": last, "price": price * sgn, "funding_pnl": fund * sgn})
    turn = F.when(F.col("_first"), 0.0).otherwise(F.abs("price") * rate) if rebalance else F.lit(0.0)
    d = d.withColumn("cost", F.col("_first").cast("double") * rate + F.col("_last").cast("double") * rate + turn)
    return d.withColumn("gross", F.col("price") + F.col("funding_pnl")).withColumn("net", F.col("gross") - F.col("cost")).drop("_first", "_last")


def liquidation_stress(marked: DataFrame, leverages: Sequence[float], spot_bps: float = 10.0, perp_bps: float = 5.0, slip_bps: float = 5.0) -> DataFrame:
    """Charge the lost margin and a re-hedge when the adverse basis exceeds 1/leverage; one copy of the rows per leverage."""
    rate = (spot_bps + perp_bps) * 1e-4 + 2.0 * slip_bps * 1e-4
    d = marked.withColumn("leverage", F.explode(F.array(*[F.lit(float(x)) for x in leverages])))
    hit = F.col("adverse_dbasis") > 1.0 / F.col("leverage")
    return d.withColumn("liquidated", hit).withColumn("net", F.col("net") - F.when(hit, 1.0 / F.col("leverage") + rate).otherwise(0.0))


def liquidation_tail(marked: DataFrame, leverages: Sequence[float]) -> DataFrame:
    x = F.col("adverse_dbasis")
    q = exact_quantiles(marked, x, [0.999, 0.99], name="_q").select((F.col("_q")[0] * 100).alias("p999_pct"), (F.col("_q")[1] * 100).alias("p99_pct"))
    d = marked.agg((F.max(x) * 100).alias("max_pct"), *[F.count_if(x > 1.0 / v).alias(f"liq_{v:g}x") for v in leverages])
    return d.crossJoin(q)  # one-row tables


# ---------------------------------------------------------------- scenario tables

def scenario_rows(scenarios: Sequence[tuple[str, float, int, float]]) -> Column:
    """(name, cost multiple, delay, sign) literals to explode next to the daily rows."""
    return F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(float(c)).alias("cost_multiple"), F.lit(int(d)).alias("delay"), F.lit(float(s)).alias("flip")) for n, c, d, s in scenarios])


STANDARD_SCENARIOS = (("base", 1.0, 0, 1.0), ("cost_x2", 2.0, 0, 1.0), ("cost_x3", 3.0, 0, 1.0), ("delay_1", 1.0, 1, 1.0), ("delay_2", 1.0, 2, 1.0), ("inverted", 1.0, 0, -1.0))


def stress(df: DataFrame, signal: str = "signal", ret: str = "ret", bps: float = 2.0, scenarios: Sequence[tuple[str, float, int, float]] = STANDARD_SCENARIOS,
           key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """All cost, delay and placebo variants of one signal in a single windowed plan; rows per (variant, key, time).

    The lags for every delay are taken before the scenarios are exploded, so the ordered pass runs once.
    """
    w = by(key, time)
    delays = sorted({d for _, _, d, _ in scenarios})
    pos = {d: F.coalesce(F.lag(signal, 1 + d).over(w), F.lit(0.0)) for d in delays}
    x = df.withColumns({f"_p{d}": pos[d] for d in delays})
    x = x.withColumns({f"_t{d}": F.abs(F.col(f"_p{d}") - F.coalesce(F.lag(f"_p{d}").over(w), F.lit(0.0))) for d in delays})
    x = x.withColumn("_v", F.explode(scenario_rows(scenarios)))
    pick = lambda p: F.coalesce(*[F.when(F.col("_v.delay") == d, F.col(f"{p}{d}")) for d in delays])
    out = x.withColumns({"variant": F.col("_v.variant"), "position": pick("_p") * F.col("_v.flip"), "turnover": pick("_t")})
    out = out.withColumn("net_return", F.col("position") * F.col(ret) - F.col("turnover") * (bps / 1e4) * F.col("_v.cost_multiple"))
    return out.drop("_v", *[f"_{a}{d}" for a in "pt" for d in delays])


def sensitivity_cases(audit: bool = False) -> list[tuple[float, str, float, float, float]]:
    """(borrow, fill, q, gross, ADV share) cases: the 8 standard ones or the 108 of the audit."""
    borrow, fills = ((1.0, 2.0, 3.0), ("open", "hlc3", "close")) if audit else ((1.0, 3.0), ("open", "hlc3"))
    gross, adv = ((0.5, 1.0, 2.0), (0.01, 0.03)) if audit else ((1.0,), (0.01,))
    return list(itertools.product(borrow, fills, (0.05, 0.10), gross, adv))


def book_sensitivity(panel: DataFrame, cases: Sequence[tuple[float, str, float, float, float]], equity: float = 1e6, min_names: int = 5, name_cap: float = 0.05,
                     financing_rate: float = 0.05, commission_bps: float = 0.5) -> DataFrame:
    """Mean daily P&L of every (borrow, fill, q, gross, ADV share) case in one plan.

    The cross-section is ranked once.  Then the rows of a symbol stay in one task, with those that no book may hold: there the distinct (q, gross, ADV)
    books stand side by side as rows and meet the book before by a lag, so no row of a book is shuffled.  Fill models and borrow multiples re-price the
    same trades as columns.
    """
    panel = book_inputs(panel)
    books = sorted({c[2:] for c in cases})
    key = ["q_quantile", "target_gross", "adv_participation_pct"]
    fills = ("open", "hlc3", "close")
    sized = lambda d: d.withColumn("_c", F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(key, b)]) for b in books]))).select("*", "_c.*").drop("_c") \
        .withColumn("_k", F.greatest(F.bround(F.col("_n") * F.col("q_quantile")), F.lit(1), F.lit(min_names)).cast("long"))
    ok = F.coalesce(F.col("tradable") & F.col("in_pit_universe"), F.lit(False))
    days = sized(panel.filter(ok).groupBy("execution_date").agg(F.count(F.lit(1)).alias("_n"))).filter(2 * F.col("_k") <= F.col("_n"))
    days = days.select(*key, "execution_date", F.row_number().over(W.partitionBy(*key).orderBy("execution_date")).alias("book_no"), F.lead("execution_date").over(W.partitionBy(*key).orderBy("execution_date")).alias("_after"))  # books × dates
    ranked = ordinal(panel.filter(ok), "y_xs_pred", "_r", ("execution_date",), ("symbol",), size="_n")
    rows = ranked.unionByName(panel.filter(~ok), allowMissingColumns=True).select(
        "execution_date", "symbol", "_r", "_n", "adv_20d_dollar_lag1", F.col("borrow_tier").alias("tier"), "roll_spread_bps", F.col("close").alias("_close"), *[fill_price(f).alias(f"fill_{f}") for f in fills])
    r = sized(by_key(rows, panel, "symbol")).join(F.broadcast(days), [*key, "execution_date"])
    gross = F.col("target_gross") * equity
    side = F.when(F.col("_r") > F.col("_n") - F.col("_k"), 1.0).when(F.col("_r") <= F.col("_k"), -1.0)
    size = F.least(gross / 2.0 / F.col("_k"), F.col("adv_20d_dollar_lag1") * F.col("adv_participation_pct"), gross * name_cap)
    w = W.partitionBy("symbol", *key).orderBy("book_no")
    r = r.withColumn("_signed", side * size).drop("_r", "_n", "_k", "adv_20d_dollar_lag1")
    r = r.withColumns({"_before": F.lag("book_no").over(w), "_last": F.lag("_signed").over(w), "_paid": F.lag("_close").over(w), "_next": F.lead("book_no").over(w)})
    r = r.withColumn("_held", F.when(F.col("_before") == F.col("book_no") - 1, F.col("_last"))).withColumn("_gone", F.coalesce(F.col("_next") != F.col("book_no") + 1, F.lit(True)) & F.col("_signed").isNotNull() & F.col("_after").isNotNull())
    r = r.filter(F.col("_signed").isNotNull() | F.col("_held").isNotNull())
    here, null = F.col("_signed").isNotNull(), F.lit(None)
    today = F.struct(F.col("execution_date"), F.coalesce("_signed", F.lit(0.0)).alias("signed_new"), F.coalesce("_held", F.lit(0.0)).alias("signed_prev"), F.col("_paid").alias("close_prev"), F.col("_close").alias("close_today"),
                     F.when(here, F.col("tier")).alias("tier"), F.when(here, F.col("roll_spread_bps")).alias("roll_spread_bps"), *[F.when(here, F.col(f"fill_{f}")).alias(f"fill_{f}") for f in fills], here.alias("_new"))
    # a name of this book without a row on the day of the next one leaves it there, unpriced
    leaves = F.struct(F.col("_after").alias("execution_date"), F.lit(0.0).alias("signed_new"), F.col("_signed").alias("signed_prev"), F.col("_close").alias("close_prev"), null.cast("double").alias("close_today"),
                      null.cast("string").alias("tier"), null.cast("double").alias("roll_spread_bps"), *[null.cast("double").alias(f"fill_{f}") for f in fills], F.lit(False).alias("_new"))
    m = r.select(*key, F.explode(F.when(F.col("_gone"), F.array(today, leaves)).otherwise(F.array(today))).alias("_m")).select(*key, "_m.*")
    change = F.col("signed_new") - F.col("signed_prev")
    lot = lambda f: F.coalesce(F.sum(F.when(change != 0, change / F.col(f"fill_{f}") * (F.col("close_today") - F.col(f"fill_{f}")))), F.lit(0.0))
    d = m.groupBy(*key, "execution_date").agg(
        F.coalesce(F.sum(F.when(F.col("signed_prev") != 0, F.col("signed_prev") * (F.col("close_today") / F.col("close_prev") - 1.0))), F.lit(0.0)).alias("held"), *[lot(f).alias(f"lot_{f}") for f in fills],
        F.sum(commission(F.abs(change), commission_bps)).alias("comm"), F.sum(half_spread_cost(F.abs(change), F.col("roll_spread_bps"), F.coalesce("tier", F.lit("general")), F.when(F.col("_new"), F.col("execution_date")))).alias("spread"),
        F.sum(borrow_cost(F.col("signed_new"), F.col("tier"))).alias("borrow"), F.sum(F.abs("signed_new")).alias("gross"))
    fixed = F.col("held") - F.col("comm") - F.col("spread") - financing_cost(F.col("gross"), equity, financing_rate)
    d = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n_days"), F.avg(fixed).alias("_fixed"), F.avg("borrow").alias("_borrow"), *[F.avg(f"lot_{f}").alias(f"_lot_{f}") for f in fills])
    grid = F.array(*[F.struct(F.lit(b).alias("borrow_multiplier"), F.lit(f).alias("fill_model"), *[F.lit(float(v)).alias(f"_{k}") for k, v in zip(key, rest)]) for b, f, *rest in cases])
    mine = F.filter(grid, lambda c: (c["_q_quantile"] == F.col("q_quantile")) & (c["_target_gross"] == F.col("target_gross")) & (c["_adv_participation_pct"] == F.col("adv_participation_pct")))
    d = d.withColumn("_c", F.explode(mine)).withColumns({"borrow_multiplier": F.col("_c.borrow_multiplier"), "fill_model": F.col("_c.fill_model")})
    lots = F.coalesce(*[F.when(F.col("fill_model") == f, F.col(f"_lot_{f}")) for f in fills])
    return d.select("borrow_multiplier", "fill_model", *key, "n_days", (F.col("_fixed") + lots - F.col("borrow_multiplier") * F.col("_borrow")).alias("mean_daily_net"))


def window_report(daily: DataFrame, windows: Sequence[tuple[str, str, str]], ret: str = "net_return", keys: Sequence[str] = ("strategy",)) -> DataFrame:
    """Return, Sharpe and drawdown inside named date windows (a short literal list exploded next to the rows)."""
    lit = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")) for n, a, b in windows])
    d = daily.withColumn("_w", F.explode(F.filter(lit, lambda v: F.col("date").between(v["lo"], v["hi"])))).withColumn("label", F.col("_w.label")).drop("_w")
    return mt.daily_metrics(d, ret, [*keys, "label"])


def flip_diagnostics(daily: DataFrame, position: str = "position", ret: str = "ret", horizon: int = 20, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Turnover diagnostics per key: flips, time in market, and the mean compounded return after re-entries."""
    w = by(key)
    nxt = F.aggregate(F.collect_list(F.col(ret)).over(w.rowsBetween(1, horizon)), F.lit(1.0), lambda a, v: a * (1.0 + v), lambda a: a - 1.0)
    d = daily.withColumns({"_prev": F.coalesce(F.lag(position).over(w), F.lit(0.0)), "_next": nxt})
    entry = (F.col("_prev") == 0) & (F.col(position) > 0)
    return d.groupBy(*key).agg(F.count_if(F.col(position) != F.col("_prev")).alias("n_flips"), F.avg((F.col(position) > 0).cast("double")).alias("exposure"),
                               F.count_if(entry).alias("n_entries"), F.avg(F.when(entry, F.col("_next"))).alias("mean_return_after_entry"))


def crash_protection(daily: DataFrame, position: str = "position", ret: str = "ret", worst: float = 0.05, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of the worst underlying days that the position missed, and the P&L kept on them."""
    cut = daily.groupBy(*key).agg(F.percentile(ret, F.lit(worst)).alias("_cut"))
    d = daily.join(cut, list(key)).filter(F.col(ret) <= F.col("_cut"))
    return d.groupBy(*key).agg(F.count(F.lit(1)).alias("n_worst_days"), F.avg((F.col(position) == 0).cast("double")).alias("avoided_share"), F.sum(F.col(position) * F.col(ret)).alias("pnl_on_worst"),
                               F.sum(ret).alias("underlying_on_worst"))


# ---------------------------------------------------------------- refreshed long/short names

def refreshed_long_short(df: DataFrame, prediction: str, outcome: str, every: int = 5, fraction: float = 0.1, cost_bps: float = 5.0, max_names: int | None = None) -> DataFrame:
    """Names picked on every ``every``-th day and held between; equal weights, full turnover cost on refresh days.

    A day counts in the index even when it has fewer than two rows; such a day is skipped, and a
    scheduled refresh falling on it is not made up.  The refresh day of a block is the last usable day
    that is scheduled, or the first usable day; the held names then meet the block's days by an equi join.
    """
    r = ordinal(df, prediction, "_r", ("date",), ("symbol",), descending=True, size="_n")
    days = r.groupBy("date").agg(F.max("_n").alias("_rows"))
    w = W.orderBy("date")
    days = days.withColumn("_i", F.row_number().over(w) - 1).filter("_rows >= 2")
    first = F.row_number().over(w) == 1
    pick = F.when((F.col("_i") % every == 0) | first, F.col("date"))
    days = days.withColumn("refresh", F.last(pick, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).select("date", "refresh")  # calendar-sized
    n = F.least(F.greatest(F.floor(F.col("_n") * fraction), F.lit(1)), F.greatest(F.floor(F.col("_n") / 2), F.lit(1)))
    if max_names is not None:
        n = F.least(n, F.lit(max_names))
    sides = r.select("symbol", F.col("date").alias("refresh"), F.when(F.col("_r") <= n, F.lit(1)).when(F.col("_r") > F.col("_n") - n, F.lit(-1)).alias("_side")).filter("_side IS NOT NULL")
    live = df.join(F.broadcast(days), "date").join(sides, ["symbol", "refresh"])
    y = F.col(outcome)
    out = live.groupBy("date", "refresh").agg(F.count_if(F.col("_side") == 1).alias("long_count"), F.count_if(F.col("_side") == -1).alias("short_count"),
                                            F.avg(F.when(F.col("_side") == 1, y)).alias("long_mean"), F.avg(F.when(F.col("_side") == -1, y)).alias("short_mean"))
    out = out.filter("long_count > 0 AND short_count > 0").withColumn("rebalanced", (F.col("date") == F.col("refresh")).cast("int"))
    out = out.withColumns({"gross_return": 0.5 * F.col("long_mean") - 0.5 * F.col("short_mean"), "turnover": 2.0 * F.col("rebalanced")})
    out = out.withColumn("net_return", F.col("gross_return") - F.col("turnover") * cost_bps * 1e-4).drop("refresh")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return out.withColumns({"gross_equity": F.product(1.0 + F.col("gross_return")).over(upto), "equity": F.product(1.0 + F.col("net_return")).over(upto)})


def grouped_long_short(df: DataFrame, prediction: str, outcome: str, weight: str, group: str = "date", ties: Sequence[str] = ("symbol",), fraction: float = 0.1) -> DataFrame:
    """Weighted outcome of the top and bottom fraction per group, in P&L units, with the running total."""
    r = ordinal(df, prediction, "_r", (group,), ties, descending=True, size="_n").filter("_n >= 2")
    n = F.least(F.greatest(F.floor(F.col("_n") * fraction), F.lit(1)), F.greatest(F.floor(F.col("_n") / 2), F.lit(1)))
    long, short = F.col("_r") <= n, F.col("_r") > F.col("_n") - n
    wmean = lambda side: F.coalesce(div(F.sum(F.when(side, F.col(weight) * F.col(outcome))), F.sum(F.when(side, F.col(weight)))), F.lit(0.0))
    d = r.groupBy(group).agg(F.count_if(long).alias("long_count"), F.count_if(short).alias("short_count"), wmean(long).alias("long_capture"), wmean(short).alias("short_capture"))
    d = d.withColumn("pnl_units", 0.5 * (F.col("long_capture") - F.col("short_capture")))
    return d.withColumn("cumulative_pnl_units", F.sum("pnl_units").over(W.orderBy(group).rowsBetween(W.unboundedPreceding, 0)))
