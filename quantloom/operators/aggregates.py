"""Grouped reports: compounding, exposures, concentration, summaries, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div, month_of
from quantloom.functions.rolling import rolling
from quantloom.operators.quantiles import exact_quantiles


def compound(df: DataFrame, ret: str, group: Sequence[Column | str], name: str = "total_return") -> DataFrame:
    """Compounded return per group."""
    return df.groupBy(*group).agg((F.product(1.0 + F.col(ret)) - 1.0).alias(name), F.count(F.lit(1)).alias("n_periods"))


def period_returns(df: DataFrame, ret: str, period: str, keys: Sequence[str] = ()) -> DataFrame:
    p = {"day": F.date_format("date", "yyyy-MM-dd"), "month": month_of("date"), "year": F.date_format("date", "yyyy")}[period]
    return compound(df, ret, [*keys, p.alias("period")])


def book_by_date(df: DataFrame, ret: str, keys: Sequence[str] = ("variant",), taken: Column | None = None) -> DataFrame:
    """Equal-weight event book: mean and sum of the taken trades per date."""
    x = F.when(taken, F.col(ret)) if taken is not None else F.col(ret)
    return df.groupBy(*keys, "date").agg(F.avg(x).alias("mean_return"), F.sum(x).alias("sum_return"), F.count(x).alias("n_trades"))


def exposures(positions: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Net, gross, long and short exposure per date and long/short per sector."""
    x = F.col("signed_notional")
    aggs = [F.sum(x).alias("net"), F.sum(F.abs(x)).alias("gross"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("long"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("short")]
    for s in sectors:
        here = F.col("sector") == s
        aggs += [F.sum(F.when(here & (x > 0), x).otherwise(0.0)).alias(f"long_{s}"), F.sum(F.when(here & (x < 0), -x).otherwise(0.0)).alias(f"short_{s}")]
    return positions.groupBy("date").agg(*aggs)


def pnl_decomposition(daily: DataFrame, parts: Sequence[str], equity: float) -> DataFrame:
    """Mean daily basis points of equity per P&L part and in total."""
    bps = [(F.sum(p) / equity / F.count(F.lit(1)) * 1e4).alias(f"{p}_bps") for p in parts]
    return daily.agg(*bps, F.count(F.lit(1)).alias("n_days"))


def leaderboard(metrics: DataFrame, group: str) -> DataFrame:
    return metrics.groupBy(group).agg(F.avg("sharpe").alias("sharpe_mean"), F.max("sharpe").alias("sharpe_max"), F.stddev_samp("sharpe").alias("sharpe_std"),
                                      F.avg("total_return").alias("ret_mean"), F.min("max_drawdown").alias("mdd_worst"), F.count(F.lit(1)).alias("n_strategies"))


def percentile_summary(df: DataFrame, x: str, points: Sequence[int] = (1, 5, 25, 50, 75, 95, 99)) -> DataFrame:
    q = exact_quantiles(df, x, [p / 100.0 for p in points], name="p")
    return q.crossJoin(df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))).select(  # one-row tables
        *[F.get("p", i).alias(f"p{p}") for i, p in enumerate(points)], "mean", "std")


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram between the minimum and maximum; the maximum falls into the last bin."""
    lo_hi = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    d = df.select(x).crossJoin(F.broadcast(lo_hi))  # one-row side
    b = F.least(F.floor(F.coalesce(div(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.5)) * bins), F.lit(bins - 1))
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trade_buckets(trades: DataFrame, bucket: str) -> DataFrame:
    """Trade statistics by bucket.  ``log_compounded`` adds logarithms, as the product itself leaves the range of a double over many trades; NaN if a trade loses more than all."""
    growth = F.when(F.col("net") > -1.0, F.log1p("net")).when(F.col("net") == -1.0, F.lit(float("-inf"))).when(F.col("net").isNotNull(), F.lit(float("nan")))
    return trades.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.avg("cost").alias("mean_cost"),
                                      F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), (F.product(1.0 + F.col("net")) - 1.0).alias("compounded"),
                                      F.sum(growth).alias("log_compounded"))


def signed_share(pnl: DataFrame, key: Column | str, x: str = "pnl") -> DataFrame:
    """Largest share of one key in the signed total."""
    per = pnl.groupBy((F.col(key) if isinstance(key, str) else key).alias("k")).agg(F.sum(x).alias("v"))
    tot = per.agg(F.sum("v").alias("t"), F.max("v").alias("m"))
    return tot.select(F.coalesce(div("m", "t"), F.lit(0.0)).alias("max_share"))


def abs_share_by_period(pnl: DataFrame, period: Column, x: str = "pnl") -> DataFrame:
    """Share of each period in the total absolute P&L, with a flag above one half."""
    per = pnl.groupBy(period.alias("period")).agg(F.sum(x).alias("pnl"))
    tot = per.agg(F.sum(F.abs("pnl")).alias("_t"))
    d = per.crossJoin(F.broadcast(tot))  # one-row side
    return d.withColumn("share", F.coalesce(div(F.abs("pnl"), "_t"), F.lit(0.0))).withColumn("dominant", F.col("share") > 0.5).drop("_t")


def positive_concentration(pnl: DataFrame, x: str = "pnl") -> DataFrame:
    """Best day, trade and symbol as shares of the positive P&L, blockers, and the return without the best day."""
    pos = lambda v: F.greatest(v, F.lit(0.0))
    day = pnl.groupBy("date").agg(F.sum(x).alias("v")).agg(F.sum(pos(F.col("v"))).alias("day_total"), F.max("v").alias("best_day"),
                                                         F.max_by("date", F.struct("v", "date")).alias("best_date"), F.sum("v").alias("total"))
    sym = pnl.groupBy("symbol").agg(F.sum(x).alias("v")).agg(F.sum(pos(F.col("v"))).alias("sym_total"), F.max("v").alias("best_sym"))
    trade = pnl.agg(F.sum(pos(F.col(x))).alias("trade_total"), F.max(x).alias("best_trade"))
    d = day.crossJoin(sym).crossJoin(trade)  # three one-row tables
    share = lambda a, b: F.coalesce(div(pos(F.col(a)), b), F.lit(0.0))
    d = d.select("best_date", share("best_day", "day_total").alias("best_day_share"), share("best_trade", "trade_total").alias("best_trade_share"),
                 share("best_sym", "sym_total").alias("best_symbol_share"), (F.col("total") - F.col("best_day")).alias("pnl_without_best_day"))
    return d.withColumns({"day_blocker": F.col("best_day_share") > 0.25, "trade_blocker": F.col("best_trade_share") > 0.20, "symbol_blocker": F.col("best_symbol_share") > 0.35})


def sharpe_of(x: str | Column, k: float = 252.0) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(div(F.avg(c), F.stddev_samp(c)), F.lit(0.0)) * (k ** 0.5)


def per_year(daily: DataFrame, ret: str, keys: Sequence[str] = (), k: float = 252.0) -> DataFrame:
    return daily.groupBy(*keys, F.year("date").alias("year")).agg(sharpe_of(ret, k).alias("sharpe"), (F.avg(ret) * k).alias("annual_return"),
                                                                F.sum(ret).alias("total"), F.count(F.lit(1)).alias("n_days"))


def excluding_years(daily: DataFrame, ret: str, years: Sequence[int], before: int) -> DataFrame:
    """Sharpe without each named year and over the days before a year, in one pass."""
    y = F.year("date")
    aggs = [sharpe_of(F.when(y != v, F.col(ret))).alias(f"sharpe_ex_{v}") for v in years] + [sharpe_of(F.when(y < before, F.col(ret))).alias(f"sharpe_pre_{before}")]
    return daily.agg(*aggs)


def pooled_book(results: DataFrame, columns: Sequence[str], time: str = "date") -> DataFrame:
    """Equal-weight mean over the assets present at each time."""
    return results.groupBy(time).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_assets"))


def equal_risk(sleeves: DataFrame, names: Sequence[str], ret: str = "ret", key: str = "sector", n: int = 60, default: float = 0.02, floor: float = 5e-4) -> DataFrame:
    """Inverse-volatility weights across a short list of sleeves; a sleeve without a return on a date earns zero.

    The volatility is over n dates of the zero-filled series; a missing one counts as ``default``.
    """
    grid = sleeves.select("date").distinct().select("date", F.explode(F.array(*[F.lit(x) for x in names])).alias(key))
    d = grid.join(sleeves.select("date", key, F.col(ret).alias("_r")), ["date", key], "left").withColumn("_r", F.coalesce("_r", F.lit(0.0)))
    d = rolling(d, {"_sd": ("std", "_r", n)}, [key])
    d = d.withColumn("_w", 1.0 / F.greatest(F.coalesce("_sd", F.lit(default)), F.lit(floor)))
    return d.groupBy("date").agg(div(F.sum(F.col("_w") * F.col("_r")), F.sum("_w")).alias("net_return"))


def top_contributors(pnl: DataFrame, key: str, n: int, x: str = "pnl") -> DataFrame:
    return pnl.groupBy(key).agg(F.sum(x).alias("pnl")).orderBy(F.col("pnl").desc(), key).limit(n)


def hit_and_block_rate(signals: DataFrame) -> DataFrame:
    """Weighted hit rate over signals with a direction and a weight, and the share of blocked decisions of all."""
    live = (F.col("predicted_direction") != 0) & (F.col("weight") > 0)
    hit = live & (F.col("predicted_direction") == F.col("realized_direction"))
    return signals.agg(F.coalesce(div(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)), F.sum(F.when(live, F.col("weight")).otherwise(0.0))), F.lit(0.0)).alias("hit_rate"),
                       F.count_if(live).alias("n_signals"), F.count_if(hit).alias("n_hits"),
                       F.coalesce(F.avg(F.col("decision").isin("veto", "insufficient_evidence").cast("double")), F.lit(0.0)).alias("governor_block_rate"))


def daily_fill_pnl(fills: DataFrame, equity: float) -> DataFrame:
    """direction × |weight × price| × return − fee per fill, summed by date, as a share of equity, and the day's loss.

    A fill without direction, price or realised return contributes nothing, its fee included.
    """
    ok = F.col("fill_price").isNotNull() & (F.col("predicted_direction") != 0) & F.col("realized_return").isNotNull()
    row = F.when(ok, F.col("predicted_direction") * F.abs(F.col("weight") * F.col("fill_price")) * F.col("realized_return") - F.col("fee")).otherwise(0.0)
    d = fills.groupBy("date").agg(F.sum(row).alias("daily_pnl"), F.count(F.lit(1)).alias("n_rows"))
    return d.withColumn("daily_pnl_pct", F.col("daily_pnl") / equity).withColumn("daily_dd_pct", F.abs(F.least("daily_pnl_pct", F.lit(0.0))))


def rolling_sharpe_by_days(daily: DataFrame, x: str, days: int, k: float = 252.0) -> DataFrame:
    """Sharpe over a calendar-day range window (one row per date)."""
    w = W.orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    s = div(F.avg(x).over(w), F.stddev_samp(x).over(w)) * (k ** 0.5)
    return daily.withColumn("rolling_sharpe", F.when(F.count(x).over(w) >= 2, F.coalesce(s, F.lit(0.0))))


def monthly_equity(daily: DataFrame, equity: str = "equity", cost: str = "cost") -> DataFrame:
    return daily.groupBy(month_of("date").alias("month")).agg(F.min_by(equity, "date").alias("start_equity"), F.max_by(equity, "date").alias("end_equity"),
                                                            F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n_days")).withColumn(
        "income", F.col("end_equity") - F.col("start_equity")).withColumn("month_return", div("end_equity", "start_equity") - 1.0)


def monthly_summary(months: DataFrame) -> DataFrame:
    x = "month_return"
    return months.agg(F.count(F.lit(1)).alias("n_months"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("best"), F.min(x).alias("worst"),
                      F.avg((F.col(x) > 0).cast("double")).alias("positive_share"))


def table_profile(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
