"""Reviews of a book: baskets without one group, shares of the result, crisis windows, and the metrics a validation run needs.

Every review is one aggregation to (group, date) or (strategy, date), which the calendar bounds; complements are the whole less the group, so no basket is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.functions.noise import uniform
from quantloom.operators import backtest as bt
from quantloom.operators import metrics as mt
from quantloom.operators.aggregates import sharpe_of


def leave_group_out(daily: DataFrame, group: str, names: Sequence[str], starts: Sequence[tuple[str, str]], ret: str = "net_return") -> DataFrame:
    """Metrics of the equal-weight basket, whole (``none``) and without each group, from several starts of the holdout.

    ``daily`` has one row per (instrument, date).  A date on which nothing but the group trades has no basket.
    """
    g = daily.groupBy(F.col(group).alias("excluded"), "date").agg(F.sum(ret).alias("_s"), F.count(ret).alias("_n"))
    whole = g.groupBy("date").agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_count"))
    d = whole.withColumn("excluded", F.explode(F.array(*[F.lit(x) for x in ("none", *names)]))).join(g, ["excluded", "date"], "left")
    rest = F.col("_count") - F.coalesce("_n", F.lit(0))
    d = d.filter(rest > 0).select("excluded", "date", ((F.col("_all") - F.coalesce("_s", F.lit(0.0))) / rest).alias("net_return"))
    cuts = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("lo")) for n, a in starts])
    d = d.withColumn("start", F.explode(F.filter(cuts, lambda v: F.col("date") >= v["lo"]))).withColumn("start", F.col("start.label"))
    return mt.daily_metrics(d, "net_return", ["excluded", "start"])


def pnl_shares(daily: DataFrame, group: str, pnl: str = "net_return") -> DataFrame:
    """(kind, name, pnl, share): result by instrument group and by year, as shares of the signed total (null when the total is 0)."""
    per = daily.groupBy(F.col(group).cast("string").alias("group"), F.year("date").cast("string").alias("year")).agg(F.sum(pnl).alias("_v"))
    d = per.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("group", "year")])).alias("k"), "_v").groupBy("k.kind", "k.name").agg(F.sum("_v").alias("pnl"))
    return d.withColumn("share", div("pnl", F.sum("pnl").over(W.partitionBy("kind"))))


def crisis_windows(book: DataFrame, windows: Sequence[tuple[str, str, str]], ret: str = "net_return", bench: str = "bench_return") -> DataFrame:
    """Strategy against benchmark in named windows and outside all of them (``calm``): returns, drawdowns, what was avoided, Sharpes."""
    sides = F.array(F.struct(F.lit("strategy").alias("side"), F.col(ret).alias("r")), F.struct(F.lit("bench").alias("side"), F.col(bench).alias("r")))
    lit = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")) for n, a, b in windows])
    mine = F.transform(F.filter(lit, lambda v: F.col("date").between(v["lo"], v["hi"])), lambda v: v["label"])
    labels = F.when(F.size(mine) > 0, mine).otherwise(F.array(F.lit("calm")))
    d = book.withColumn("label", F.explode(labels)).withColumn("s", F.explode(sides)).select("date", "label", "s.side", "s.r")
    m = mt.daily_metrics(d, "r", ["label", "side"]).groupBy("label").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{n}") for s in ("strategy", "bench") for c, n in (("total_return", "return"), ("max_drawdown", "drawdown"), ("sharpe", "sharpe"))],
        F.max("n_days").alias("n_days"))
    return m.withColumns({"avoided_drawdown": F.col("strategy_drawdown") - F.col("bench_drawdown"), "relative_return": F.col("strategy_return") - F.col("bench_return")})


def validation_metrics(panel: DataFrame, holdout_start: str, key: str = "symbol", signal: str = "signal", ret: str = "ret", bps: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per strategy: development and holdout Sharpe, stressed Sharpes, the largest share of a month, and a random placebo.

    ``panel`` has (key, date, signal, ret).  The scenarios share one ordered pass; the placebo's sides are drawn by (seed, key, date).
    """
    dev = F.col("date") < F.lit(holdout_start).cast("date")
    coin = F.when(uniform(key, "date", seed=seed) < 0.5, -1.0).otherwise(1.0)
    s = bt.stress(panel.withColumn(signal, F.col(signal).cast("double")), signal, ret, bps, key=(key,))
    n = F.col("net_return")
    of = lambda v: sharpe_of(F.when(dev & (F.col("variant") == v), n))
    base = F.col("variant") == "base"
    m = s.groupBy(key).agg(of("base").alias("dev_sharpe"), sharpe_of(F.when(base & ~dev, n)).alias("holdout_sharpe"),
                           *[of(v).alias(f"sharpe_{v}") for v in ("base", "cost_x2", "cost_x3", "delay_1", "delay_2", "inverted")], F.count(F.when(base & dev, n)).alias("n_dev"), F.count(F.when(base & ~dev, n)).alias("n_holdout"))
    months = s.filter(base & dev).groupBy(key, F.trunc("date", "month").alias("_m")).agg(F.sum("net_return").alias("_v"))
    months = months.groupBy(key).agg(F.coalesce(div(F.max(F.abs("_v")), F.sum(F.abs("_v"))), F.lit(0.0)).alias("max_month_share"))
    placebo = panel.filter(dev).groupBy(key).agg(sharpe_of(coin * F.col(ret)).alias("sharpe_random"))
    return m.join(months, key, "left").join(placebo, key, "left")


def sleeve_phases(sleeves: DataFrame, book: DataFrame, phases: Sequence[tuple[str, str, str]], sector: str = "sector", ret: str = "net_return") -> DataFrame:
    """Sharpe of the aggregate by phase with the number of sectors that earn and the largest share of one sector in the positive total."""
    d = bt.window_report(book.withColumn("strategy", F.lit("aggregate")), phases, "net_return")
    per = bt.window_report(sleeves.withColumnRenamed(sector, "strategy"), phases, ret)
    pos: Column = F.greatest(F.col("sum_return"), F.lit(0.0))
    lit = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")) for n, a, b in phases])
    sums = sleeves.withColumn("_w", F.explode(F.filter(lit, lambda v: F.col("date").between(v["lo"], v["hi"])))).groupBy(F.col(sector).alias("strategy"), F.col("_w.label").alias("label")).agg(F.sum(ret).alias("sum_return"))
    shares = per.join(sums, ["strategy", "label"]).groupBy("label").agg(F.count_if(F.col("sum_return") > 0).alias("n_positive"), F.coalesce(div(F.max(pos), F.sum(pos)), F.lit(0.0)).alias("max_sector_share"))
    return d.select("label", "sharpe", "total_return", "max_drawdown", "n_days").join(shares, "label")
