"""Performance metrics as aggregates: Sharpe family, drawdown, accuracy, R², attribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import col, div
from quantloom.operators.blocks import blocked

BIG = 1e6


def sharpe(x: str | Column, k: float = 252.0, zero_sd: str = "zero", ddof: int = 1) -> Column:
    """Annualised mean over deviation.  ``zero_sd``: what a constant series gives — zero, inf or big (±1e6)."""
    c = col(x)
    sd = F.stddev_samp(c) if ddof == 1 else F.stddev_pop(c)
    value = div(F.avg(c), sd) * math.sqrt(k)
    other = {"zero": F.lit(0.0), "inf": F.when(F.avg(c) > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)), "big": F.signum(F.avg(c)) * BIG}[zero_sd]
    return F.when(F.count(c) < 2, F.lit(0.0)).otherwise(F.coalesce(value, other, F.lit(0.0)))


def sortino(x: str | Column, k: float = 252.0) -> Column:
    """Mean over the sample deviation of the negative returns; 0 with fewer than two of them."""
    c = col(x)
    down = F.when(c < 0, c)
    return F.when(F.count(down) < 2, F.lit(0.0)).otherwise(F.coalesce(div(F.avg(c), F.stddev_samp(down)), F.lit(0.0)) * math.sqrt(k))


def hit_rate(x: str | Column) -> Column:
    """Share of positive among the non-zero values."""
    c = col(x)
    return F.coalesce(F.avg(F.when(c != 0, (c > 0).cast("double"))), F.lit(0.0))


def profit_factor(x: str | Column) -> Column:
    """Gains over losses; infinite without losses when there are gains, else 0."""
    c = col(x)
    gain, loss = F.sum(F.greatest(c, F.lit(0.0))), F.sum(F.greatest(-c, F.lit(0.0)))
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)


def value_at_risk(x: str | Column, level: float = 0.05) -> Column:
    """Quantile by the nearest observation, as a positive loss."""
    return -F.percentile_disc(level, col(x)) if hasattr(F, "percentile_disc") else -F.percentile(col(x), F.lit(level))


def total_return(x: str | Column) -> Column:
    return F.product(1.0 + col(x)) - 1.0


def annualized_return(x: str | Column, k: float = 252.0) -> Column:
    growth = F.product(1.0 + col(x))
    return F.when(growth > 0, F.pow(growth, F.lit(k) / F.count(col(x))) - 1.0).otherwise(F.lit(-1.0))


# ---------------------------------------------------------------- path statistics

def segments(df: DataFrame, ret: str, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sufficient statistics of a compounded path per part: end value, peak, low and worst drawdown."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_e", F.product(1.0 + F.col(ret)).over(w)).withColumn("_p", F.max("_e").over(w))
    return d.groupBy(*part).agg(F.product(1.0 + F.col(ret)).alias("end"), F.max("_e").alias("peak"), F.min("_e").alias("low"),
                                F.min(div("_e", "_p") - 1.0).alias("drawdown"), F.count(F.lit(1)).alias("n"))


def concatenate(seg: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Combine the segments of each group in order; the statistics of the joined path are exact.

    x / max(a, b) is the lesser of x/a and x/b, so the worst drawdown against an earlier peak needs
    only the low of the segment.  Paths over unbounded event tables are built bucket by bucket.
    """
    before = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = seg.withColumn("_e0", F.coalesce(F.product("end").over(before), F.lit(1.0))).withColumn("_pk", F.col("_e0") * F.col("peak"))
    d = d.withColumn("_pb", F.max("_pk").over(before))
    return d.groupBy(*group).agg(F.product("end").alias("end"), F.max("_pk").alias("peak"), F.min(F.col("_e0") * F.col("low")).alias("low"),
                                 F.min(F.least("drawdown", div(F.col("_e0") * F.col("low"), "_pb") - 1.0)).alias("drawdown"), F.sum("n").alias("n"))


def event_path(df: DataFrame, ret: str, keys: Sequence[str] = (), symbol: str = "symbol", time: str = "event_time", ties: Sequence[str] = (),
               bucket_seconds: int = 3600) -> DataFrame:
    """Compounded path over events ordered by (symbol, time): buckets, then symbols, then the whole."""
    d = df.withColumn("_bucket", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_seconds))
    s = segments(d, ret, [*keys, symbol, "_bucket"], [time, *ties])
    return concatenate(concatenate(s, [*keys, symbol], ["_bucket"]), list(keys), [symbol])


def daily_metrics(df: DataFrame, ret: str, keys: Sequence[str] = (), date: str = "date", k: float = 252.0) -> DataFrame:
    """Sharpe, Sortino, total and annualised return, hit rate, drawdown and Calmar of date-level returns."""
    base = df.groupBy(*keys).agg(sharpe(ret, k).alias("sharpe"), sortino(ret, k).alias("sortino"), total_return(ret).alias("total_return"),
                                 annualized_return(ret, k).alias("annualized_return"), hit_rate(ret).alias("hit_rate"), F.count(ret).alias("n_days"))
    one = df.withColumn("_all", F.lit(0)) if not keys else df
    part = list(keys) or ["_all"]
    dd = segments(one, ret, part, [date]).select(*part, F.col("drawdown").alias("max_drawdown"))
    out = base.join(dd, list(keys)) if keys else base.crossJoin(dd.drop("_all"))  # one-row tables without keys
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")).otherwise(0.0))


def trade_metrics(df: DataFrame, keys: Sequence[str] = (), gross: str = "gross_return", net: str = "net_return", side: str = "side") -> DataFrame:
    """Order-free trade statistics by group; the path statistics come from :func:`event_path`."""
    n, is_long = F.col(net), F.col(side) == "long"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum(F.log1p(gross)).alias("log_gross"), F.sum(F.log1p(net)).alias("log_net"),
        F.coalesce(div(F.avg(n), F.stddev_samp(n)) * F.sqrt(F.count(n).cast("double")), F.lit(0.0)).alias("trade_sharpe"),
        F.avg((F.col(gross) > 0).cast("double")).alias("gross_hit_rate"), F.avg((n > 0).cast("double")).alias("net_hit_rate"), profit_factor(net).alias("profit_factor"),
        F.avg(gross).alias("avg_trade_gross_return"), F.avg(n).alias("avg_trade_net_return"), F.count_if(is_long).alias("long_trade_count"), F.count_if(~is_long).alias("short_trade_count"),
        F.sum(F.when(is_long, n).otherwise(0.0)).alias("long_net_pnl_sum"), F.sum(F.when(~is_long, n).otherwise(0.0)).alias("short_net_pnl_sum"))


# ---------------------------------------------------------------- prediction quality

def zero_mean_r2(y: str, p: str, w: str | None = None) -> Column:
    weight = F.col(w) if w else F.lit(1.0)
    e = F.col(y) - F.col(p)
    return F.coalesce(1.0 - div(F.sum(weight * e * e), F.sum(weight * F.col(y) * F.col(y))), F.lit(0.0))


def directional_accuracy(y: str, p: str, mode: str = "positive") -> Column:
    """``positive``: (y>0) == (p>0); ``sign_where_target``: sign equality where y is not 0; ``nonzero``: where neither is 0."""
    a, b = F.col(y), F.col(p)
    if mode == "positive":
        return F.avg(((a > 0) == (b > 0)).cast("double"))
    keep = (a != 0) if mode == "sign_where_target" else (a != 0) & (b != 0)
    return F.coalesce(F.avg(F.when(keep, (F.signum(a) == F.signum(b)).cast("double"))), F.lit(0.0))


def weighted_corr(x: str, y: str, w: str) -> Column:
    a, b, k = F.col(x), F.col(y), F.col(w)
    s = F.sum(k)
    mx, my = div(F.sum(k * a), s), div(F.sum(k * b), s)
    cov = div(F.sum(k * a * b), s) - mx * my
    vx, vy = div(F.sum(k * a * a), s) - mx * mx, div(F.sum(k * b * b), s) - my * my
    return F.coalesce(div(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))), F.lit(0.0))


def safe_corr(x: str, y: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def prediction_metrics(df: DataFrame, y: str, p: str, w: str, keys: Sequence[str] = ()) -> DataFrame:
    a, b, k = F.col(y), F.col(p), F.col(w)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), zero_mean_r2(y, p, w).alias("weighted_r2"), zero_mean_r2(y, p).alias("r2"), safe_corr(y, p).alias("ic"), weighted_corr(y, p, w).alias("weighted_ic"),
        directional_accuracy(y, p).alias("acc_positive"), directional_accuracy(y, p, "sign_where_target").alias("acc_sign"), directional_accuracy(y, p, "nonzero").alias("acc_nonzero"),
        F.coalesce(div(F.sum(F.when((a != 0) & (F.signum(a) == F.signum(b)), k).otherwise(0.0)), F.sum(F.when(a != 0, k).otherwise(0.0))), F.lit(0.0)).alias("weighted_accuracy"),
        F.coalesce(div(F.sum(k * F.signum(b) * a), F.sum(k)), F.lit(0.0)).alias("sign_capture"),
        F.coalesce(F.avg(F.when(b > 0, (a > 0).cast("double"))), F.lit(0.0)).alias("precision_positive"),
        F.coalesce(F.avg(F.when(b < 0, (a < 0).cast("double"))), F.lit(0.0)).alias("precision_negative"))


def class_metrics(df: DataFrame, actual: str, predicted: str, n_classes: int) -> DataFrame:
    """Ordinal class metrics from the confusion counts (at most n² rows): errors, accuracies, quadratic kappa, macro recall."""
    cells = df.groupBy(F.col(actual).cast("int").alias("a"), F.col(predicted).cast("int").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("p").agg(F.sum("o").alias("cp"))
    diff = F.col("a") - F.col("p")
    obs = cells.agg(F.sum("o").alias("n"), F.sum(F.abs(diff) * F.col("o")).alias("ae"), F.sum(diff * diff * F.col("o")).alias("se"),
                    F.sum(F.when(diff == 0, F.col("o")).otherwise(0.0)).alias("exact"), F.sum(F.when(F.abs(diff) <= 1, F.col("o")).otherwise(0.0)).alias("near"))
    exp = rows.crossJoin(cols).agg(F.sum(diff * diff * F.col("ra") * F.col("cp")).alias("expected"))  # classes × classes
    rec = cells.groupBy("a").agg(div(F.sum(F.when(diff == 0, F.col("o")).otherwise(0.0)), F.sum("o")).alias("r")).agg(F.avg("r").alias("macro_recall"))
    d = obs.crossJoin(exp).crossJoin(rec)  # one-row tables
    return d.select(F.col("n").cast("long").alias("rows"), div("ae", "n").alias("mae"), F.sqrt(div("se", "n")).alias("rmse"), div("exact", "n").alias("accuracy"),
                    div("near", "n").alias("within_one"), (1.0 - div(F.col("se") * F.col("n"), "expected")).alias("quadratic_kappa"), "macro_recall")


def attribution(df: DataFrame, ret: str, anchor: str, keys: Sequence[str] = (), k: float = 252.0, min_rows: int = 30) -> DataFrame:
    """Correlation with, incremental Sharpe over, and residual Sharpe against an anchor series (OLS residual)."""
    both = df.filter(F.col(ret).isNotNull() & F.col(anchor).isNotNull())
    fit = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), safe_corr(ret, anchor).alias("correlation"), (sharpe(ret, k) - sharpe(anchor, k)).alias("incremental_sharpe"),
                                  F.regr_slope(ret, anchor).alias("beta"), F.regr_intercept(ret, anchor).alias("alpha"))
    d = both.join(F.broadcast(fit), list(keys)) if keys else both.crossJoin(F.broadcast(fit))  # one fit row per key
    resid = F.col(ret) - F.col("beta") * F.col(anchor)
    out = d.groupBy(*keys, "n", "correlation", "incremental_sharpe", "beta").agg(sharpe(resid, k).alias("_rs"))
    return out.withColumn("residual_sharpe", F.when(F.col("n") >= min_rows, F.col("_rs")).otherwise(0.0)).drop("_rs")


def regime_metrics(df: DataFrame, ret: str, regime: str, k: float = 252.0) -> DataFrame:
    """Metrics inside each regime with the path compounded over the regime's own days."""
    return daily_metrics(df, ret, [regime], k=k)


def round_trip_hits(fills: DataFrame, key: str = "symbol", time: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Hit rate of consecutive fill pairs: the first opens, the second closes.  Fills are met block by block."""
    d = blocked(fills, lambda x, over: x.withColumns({"_open": F.lag("price").over(over()), "_side": F.lag("side").over(over())}), back=1, time=time, ties=ties, key=key)
    pnl = (F.col("price") - F.col("_open")) * F.when(F.col("_side") == "buy", 1.0).otherwise(-1.0)
    return d.filter("_idx % 2 = 1").agg(F.coalesce(F.avg((pnl > 0).cast("double")), F.lit(0.0)).alias("hit_rate"), F.count(F.lit(1)).alias("n_round_trips"))


def phase_metrics(daily: DataFrame, ret: str, holdout_start: str, k: float = 252.0) -> DataFrame:
    """Development and holdout metrics of a daily table."""
    d = daily.withColumn("phase", F.when(F.col("date") < F.lit(holdout_start).cast("date"), "dev").otherwise("holdout"))
    return daily_metrics(d, ret, ["phase"], k=k)
