"""Signal families and grids.

A grid of strategies is data, not a loop: indicators are computed once per lookback over windows that
share one partition and order, unpivoted to rows (family, lookback), and only then meet the
thresholds.  Every further parameter (mode, volatility estimator, holding) is another column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import by, clip, div, full, last_rows, logret, next_rows, prior_rows, roll
from quantloom.functions.noise import uniform
from quantloom.functions.rolling import rolling
from quantloom.operators.features import days_since_extreme, ewmas, rolling_mad, rolling_vol
from quantloom.operators.positions import position_mode, vol_target
from quantloom.session import stored

FAMILIES = ("AROON ATR_TRAILING_TREND BOLLINGER_BREAKOUT BOLLINGER_REVERT CCI DONCHIAN_BREAKOUT EWMA_CROSS KELTNER_BREAKOUT LAGGED_MOMENTUM MACD "
            "MA_CROSSOVER MOM_SKIP RANGE_OSCILLATOR ROC ROLLING_SHARPE_MOM RSI_MEANREVERT STOCHASTIC TS_MOMENTUM VOLMANAGED_MOMENTUM VOLTGT_MOMENTUM "
            "ZSCORE_MEANREVERT").split()


def indicators(bars: DataFrame, lookback: int, families: Sequence[str] = FAMILIES) -> DataFrame:
    """Two numbers per family and row, ``<family>_<lookback>`` = struct(a, b), from shared windows."""
    n, w, fam = lookback, by(), set(families)
    c, h, lo = F.col("close"), F.col("high"), F.col("low")
    fast = max(2, n // 4)
    d = bars
    base = {"_r": logret("close", 1, w), "_mom": logret("close", n, w), "_d": c - F.lag(c).over(w), "_hl": h - lo, "_tp": (h + lo + c) / 3.0,
            "_tr": F.greatest(h - lo, F.abs(h - F.lag(c).over(w)), F.abs(lo - F.lag(c).over(w)))}
    d = d.withColumns({k: v for k, v in base.items() if k not in d.columns or k == "_mom"})
    d = d.withColumns({"_gain": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_loss": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
    d = rolling(d, {"_ma": ("avg", "close", n), "_mf": ("avg", "close", fast), "_sd": ("std", "close", n), "_vol": ("std", "_r", n), "_rm": ("avg", "_r", n),
                    "_hh": ("max", "high", n), "_ll": ("min", "low", n), "_ch": ("max", "close", n), "_cl": ("min", "close", n), "_ag": ("avg", "_gain", n),
                    "_al": ("avg", "_loss", n), "_hla": ("avg", "_hl", n), "_atr": ("avg", "_tr", n), "_tpm": ("avg", "_tp", n)})
    if "CCI" in fam:
        d = rolling_mad(d, "_tp", n, "_md")
    if "AROON" in fam:
        d = days_since_extreme(d, n)
    if fam & {"MACD", "EWMA_CROSS"}:
        d = ewmas(d, {"_e1": ("close", max(4, n // 2)), "_e2": ("close", n), "_e3": ("close", fast)})
        d = d.withColumn("_macd", F.col("_e1") - F.col("_e2"))
        d = ewmas(d, {"_sig": ("_macd", max(2, n // 4))})
    z = F.lit(None).cast("double")
    table = {
        "TS_MOMENTUM": lambda: (F.col("_mom"), z), "LAGGED_MOMENTUM": lambda: (F.log(F.lag(c, n).over(w)) - F.log(F.lag(c, 2 * n).over(w)), z),
        "MA_CROSSOVER": lambda: (div(F.col("_mf") - F.col("_ma"), "_ma"), z), "DONCHIAN_BREAKOUT": lambda: (F.lag("_hh").over(w), F.lag("_ll").over(w)),
        "BOLLINGER_REVERT": lambda: (F.col("_ma"), F.col("_sd")), "BOLLINGER_BREAKOUT": lambda: (F.col("_ma"), F.col("_sd")),
        "RSI_MEANREVERT": lambda: (100.0 - 100.0 / (1.0 + F.col("_ag") / clip("_al", 1e-9)), z), "MACD": lambda: (F.col("_macd"), F.col("_sig")),
        "VOLTGT_MOMENTUM": lambda: (F.col("_mom"), F.col("_vol")), "ZSCORE_MEANREVERT": lambda: ((c - F.col("_ma")) / clip("_sd", 1e-9), z),
        "AROON": lambda: ((F.col("since_low") - F.col("since_high")) / n * 100.0, z), "STOCHASTIC": lambda: (100.0 * (c - F.col("_ll")) / clip(F.col("_hh") - F.col("_ll"), 1e-9), z),
        "ROC": lambda: (div(c, F.lag(c, n).over(w)) - 1.0, z), "CCI": lambda: ((F.col("_tp") - F.col("_tpm")) / (0.015 * clip("_md", 1e-9)), z),
        "KELTNER_BREAKOUT": lambda: (F.col("_ma"), F.col("_hla")), "VOLMANAGED_MOMENTUM": lambda: (F.col("_mom"), F.col("_vol")),
        "EWMA_CROSS": lambda: (F.col("_e3") - F.col("_e2"), z), "ATR_TRAILING_TREND": lambda: (c - F.lag(c, n).over(w), F.col("_atr")),
        "ROLLING_SHARPE_MOM": lambda: (F.col("_rm") / (F.col("_vol") + 1e-12), z),
        "RANGE_OSCILLATOR": lambda: (F.when(F.col("_ch") > F.col("_cl"), (c - F.col("_cl")) / (F.col("_ch") - F.col("_cl")) * 2.0 - 1.0).otherwise(0.0), z),
        "MOM_SKIP": lambda: (F.log(F.lag(c, 5).over(w)) - F.log(F.lag(c, n).over(w)), z)}
    out = {f"{f}_{n}": F.struct(*[x.cast("double").alias(k) for k, x in zip("ab", table[f]())]) for f in families}
    d = d.withColumns(out)
    return d.drop(*[x for x in d.columns if x.startswith("_")], "since_high", "since_low")


def side(up: Column, down: Column, size: Column | float = 1.0) -> Column:
    s = F.lit(size) if isinstance(size, float) else size
    return F.when(up, s).when(down, -s).otherwise(F.lit(0.0))


def rule(family: Column, a: Column, b: Column, close: Column, th: Column) -> Column:
    """Position in [-1, 1] from the indicator pair and the threshold; unknown indicators give 0."""
    scaled, beyond = th / 2.5, lambda x, k: side(x > k, x < -k)
    band = th * b
    vt = clip(0.04 * th / (clip(b, 1e-6) * math.sqrt(252.0)), 0.0, 1.0)
    rules = {
        ("TS_MOMENTUM", "LAGGED_MOMENTUM", "EWMA_CROSS", "MOM_SKIP"): side(a > 0, a < 0, scaled),
        ("MA_CROSSOVER", "ROC"): beyond(a, th / 100.0),
        ("DONCHIAN_BREAKOUT",): side(close > a * (1.0 + th / 1000.0), close < b * (1.0 - th / 1000.0)),
        ("BOLLINGER_REVERT",): side(close < a - band, close > a + band),
        ("BOLLINGER_BREAKOUT", "KELTNER_BREAKOUT"): side(close > a + band, close < a - band),
        ("RSI_MEANREVERT",): side(a < 50.0 - th, a > 50.0 + th),
        ("MACD",): side(a > b * (1.0 + th / 1000.0), a < b * (1.0 - th / 1000.0)),
        ("VOLTGT_MOMENTUM",): F.coalesce(side(a > 0, a < 0, vt), F.lit(0.0)),
        ("ZSCORE_MEANREVERT",): side(a < -th, a > th),
        ("AROON",): beyond(a, th * 20.0),
        ("STOCHASTIC",): side(a < 50.0 - th * 10.0, a > 50.0 + th * 10.0),
        ("CCI",): beyond(a, th * 50.0),
        ("VOLMANAGED_MOMENTUM",): F.coalesce(F.when(b > 0, F.signum(a) * clip(0.01 / b, 0.0, 2.0) * scaled), F.lit(0.0)),
        ("ATR_TRAILING_TREND",): side((b > 0) & (a > band), (b > 0) & (a < -band)),
        ("ROLLING_SHARPE_MOM",): beyond(a, th / 5.0),
        ("RANGE_OSCILLATOR",): clip(-a * scaled, -1.0, 1.0)}
    out = F.lit(0.0)
    for names, expr in rules.items():
        out = F.when(family.isin(*names), expr).otherwise(out)
    return out


def signal_table(bars: DataFrame, families: Sequence[str], lookbacks: Sequence[int], thresholds: Sequence[float], carry: Sequence[str] = ()) -> DataFrame:
    """Long table (symbol, date, close, family, lookback, threshold, signal) of the whole grid in one plan.

    The only shuffle after the per-symbol windows spreads the indicator rows by (symbol, family,
    lookback), so a universe of few symbols still uses the whole cluster; thresholds come after it.
    """
    parts = []
    for n in lookbacks:
        # one narrow plan per lookback; all of them read the same shuffle of the bars
        d = indicators(bars, n, families)
        pairs = [F.struct(F.lit(f).alias("family"), F.lit(n).alias("lookback"), F.col(f"{f}_{n}.a").alias("a"), F.col(f"{f}_{n}.b").alias("b")) for f in families]
        parts.append(d.select("symbol", "date", "close", *carry, F.explode(F.array(*pairs)).alias("_i")).select("symbol", "date", "close", *carry, "_i.*"))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    d = d.repartition("symbol", "family", "lookback").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return d.withColumn("signal", rule(F.col("family"), F.col("a"), F.col("b"), F.col("close"), F.col("threshold"))).drop("a", "b")


SPEC = ["symbol", "family", "lookback", "threshold"]


def strategy_id(*columns: str) -> Column:
    parts = {"lookback": F.concat(F.lit("L"), F.col("lookback")), "threshold": F.format_string("T%.2f", F.col("threshold")), "holding": F.concat(F.lit("H"), F.col("holding"))} if columns else {}
    return F.concat_ws("|", *[parts.get(c, F.col(c).cast("string")) for c in columns])


def zoo_table(bars: DataFrame, families: Sequence[str], lookbacks: Sequence[int], thresholds: Sequence[float], estimators: Sequence[str], modes: Sequence[str],
              holdings: Sequence[int], target: float = 0.01, keep: DataFrame | None = None) -> DataFrame:
    """The seven-parameter grid: signal → position mode → volatility target → minimum holding.

    ``keep`` optionally holds the strategy ids of a sampled grid; they are filtered before the holding windows.
    """
    d = bars
    for n in lookbacks:
        for e in estimators:
            d = rolling_vol(d, n, e, f"vol_{e}_{n}")
    vols = [f"vol_{e}_{n}" for n in lookbacks for e in estimators]
    s = signal_table(d, families, lookbacks, thresholds, carry=vols)
    combos = [F.struct(F.lit(e).alias("vol_estimator"), F.lit(m).alias("position_mode"), F.lit(h).alias("holding")) for e in estimators for m in modes for h in holdings]
    s = s.withColumn("_c", F.explode(F.array(*combos))).select("*", "_c.*").drop("_c")
    vol = F.coalesce(*[F.when((F.col("lookback") == n) & (F.col("vol_estimator") == e), F.col(f"vol_{e}_{n}")) for n in lookbacks for e in estimators])
    s = s.withColumn("_p", vol_target(F.when(F.col("position_mode") == "long_only", position_mode("signal", "long_only")).otherwise(F.col("signal")), vol, target)).drop(*vols)
    spec = [*SPEC, "vol_estimator", "position_mode", "holding"]
    s = s.withColumn("strategy_id", strategy_id(*spec))
    if keep is not None:
        s = s.join(keep.select("strategy_id"), "strategy_id", "left_semi")
    nz = F.when(F.col("_p") != 0, F.col("_p"))
    held = {h: F.coalesce(F.last(nz, ignorenulls=True).over(last_rows(h, spec)), F.lit(0.0)) for h in holdings if h > 1}
    pos = F.col("_p")
    for h, e in held.items():
        pos = F.when(F.col("holding") == h, e).otherwise(pos)
    return s.withColumn("position", pos).drop("_p", "signal")


# ---------------------------------------------------------------- bar scores

def bar_scores(bars: DataFrame, variants: Sequence[tuple[str, str, dict[str, int]]], key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Scores of (name, family, parameters) variants as columns of one pass; missing values are 0."""
    w = by(key, time)
    d = bars.withColumn("_r", div("close", F.lag("close").over(w)) - 1.0).withColumn("_ix", F.row_number().over(w) - 1)
    specs: dict[str, tuple[str, str, int]] = {}
    for _, fam, p in variants:
        n = p.get("lookback", p.get("window", 1))
        v = p.get("vol_window", n)
        if fam in ("mean_reversion", "bollinger_reversal"):
            specs |= {f"_m{n}": ("avg", "close", n), f"_d{n}": ("std", "close", n), f"_s{n}": ("std", "_r", n)}
        if fam in ("volatility", "tsmom"):
            specs[f"_s{v}"] = ("std", "_r", v)
        if fam == "breakout":
            specs |= {f"_h{n}": ("max", "close", n), f"_l{n}": ("min", "close", n)}
        if fam in ("maker_ratio", "volume_shock"):
            x = "maker_ratio" if fam == "maker_ratio" else "volume"
            specs |= {f"_{x}m{n}": ("avg", x, n), f"_{x}s{n}": ("std", x, n)}
    d = rolling(d, specs, key, time) if specs else d
    out = {}
    for name, fam, p in variants:
        n = p.get("lookback", p.get("window", 1))
        v = p.get("vol_window", n)
        mom = div("close", F.lag("close", n).over(w)) - 1.0
        z = lambda x, n=n: (F.col(x) - F.col(f"_{x}m{n}")) / (F.col(f"_{x}s{n}") + 1e-12)
        make: dict[str, Callable[[], Column]] = {
            "always_long": lambda: F.lit(1.0), "always_short": lambda: F.lit(-1.0), "deterministic_random": lambda: F.sin(F.col("_ix") * F.lit(12.9898)), "momentum": lambda: mom,
            "mean_reversion": lambda: -(div("close", f"_m{n}") - 1.0) / (F.col(f"_s{n}") + 1e-12),
            "breakout": lambda: side(F.col("close") > F.lag(f"_h{n}").over(w), F.col("close") < F.lag(f"_l{n}").over(w)),
            "volatility": lambda: mom / (F.col(f"_s{v}") + 1e-12), "tsmom": lambda: mom / (F.col(f"_s{v}") + 1e-12),
            "bollinger_reversal": lambda: -(F.col("close") - F.col(f"_m{n}")) / (F.col(f"_d{n}") + 1e-12),
            "maker_ratio": lambda: z("maker_ratio"), "volume_shock": lambda: -F.signum("_r") * z("volume")}
        out[name] = F.coalesce(make[fam](), F.lit(0.0))
    d = d.withColumns(out)
    return d.drop(*[c for c in d.columns if c.startswith("_")])


# ---------------------------------------------------------------- cross-sectional, premium, event and allocator rules

def cross_sectional_momentum(bars: DataFrame, seed: int = 42) -> DataFrame:
    """12-1, 12-3 and 24-1 momentum, volatility-scaled 12-1, five-day reversal and a keyed random score."""
    d = bars.withColumn("_r", logret("close", 1, by()))
    d = rolling(d, {f"_s{n}": ("sum", "_r", n) for n in (5, 21, 63, 252, 504)} | {"_v": ("std", "_r", 60)})
    d = d.withColumns({"mom_12_1": F.col("_s252") - F.col("_s21"), "mom_12_3": F.col("_s252") - F.col("_s63"), "mom_24_1": F.col("_s504") - F.col("_s21"), "rev_5d": -F.col("_s5"),
                       "random": uniform("date", "symbol", seed=seed)})
    return d.withColumn("mom_12_1_vol_scaled", div("mom_12_1", clip("_v", 1e-6))).drop(*[c for c in d.columns if c.startswith("_")])


def premium_rules(f: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """The six volatility-premium rules as columns; a rule falls back to long-only when its input is absent."""
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    vrp, cols = F.col("vrp"), set(f.columns)
    med = lambda x: full(60, F.percentile(x, F.lit(0.5)), x, last_rows(60, key))
    d = f
    if "vvix_to_vix" in cols:
        d = rolling(d, {"_vm": ("avg", "vvix_to_vix", 60), "_vs": ("std", "vvix_to_vix", 60)}, key).withColumn("_vmed", med("vvix_to_vix"))
    if "skew" in cols:
        d = d.withColumn("_smed", med("skew"))
    score = F.col("vrp_z60") if "vrp_z60" in cols else vrp
    if "vvix_to_vix" in cols:
        score = score - 0.5 * (F.col("vvix_to_vix") - F.col("_vm")) / clip("_vs", 1e-9)
    if "skew_z60" in cols:
        score = score - 0.5 * F.col("skew_z60")
    return d.withColumns({
        "vrp_long_only": on(vrp > 0), "vrp_long_short": side(vrp > 0, vrp < 0), "vrp_term": on((vrp > 0) & (F.col("term_9d_30d") < 1.0)) if "term_9d_30d" in cols else on(vrp > 0),
        "vrp_vvix": on((vrp > 0) & (F.col("vvix_to_vix") < F.col("_vmed"))) if "vvix_to_vix" in cols else on(vrp > 0),
        "vrp_skew": on((vrp > 0) & (F.col("skew") < F.col("_smed"))) if "skew" in cols else on(vrp > 0), "vrp_combined": on(score > 0)}).drop("_vm", "_vs", "_vmed", "_smed")


def orthogonalised(df: DataFrame, y: str, x: str, dev: Column, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sign of the residual of ``y`` on ``x``, the line fitted on development rows only."""
    dy, dx = F.when(dev, F.col(y)), F.when(dev, F.col(x))
    fit = df.groupBy(*key).agg(F.regr_slope(dy, dx).alias("_b"), F.regr_intercept(dy, dx).alias("_a"))
    r = F.col(y) - F.col("_a") - F.col("_b") * F.col(x)
    return df.join(fit, list(key)).withColumn("signal", F.coalesce(F.signum(r), F.lit(0.0))).drop("_a", "_b")


def allocator_rules(df: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volatility target, trend, SMA gate, volatility regime, 12-1 momentum and buy-and-hold weights of an instrument.

    ``*_lag1`` columns are the event-study forms, known one row later.
    """
    w = by(key)
    d = df.withColumns({"ret": F.coalesce(div("close", F.lag("close").over(w)) - 1.0, F.lit(0.0)), "_lr": logret("close", 1, w)})
    d = rolling(d, {"_v20": ("std", "ret", 20), "_v60": ("std", "ret", 60), "_m50": ("avg", "close", 50), "_m200": ("avg", "close", 200), "_s252": ("sum", "_lr", 252), "_s21": ("sum", "_lr", 21)}, key)
    # the median ignores the undefined start of the volatility, so only the row count must be complete
    f = last_rows(252, key)
    d = d.withColumn("_med", F.when(F.count(F.lit(1)).over(f) >= 252, F.percentile("_v20", F.lit(0.5)).over(f)))
    on = lambda c: F.when(c, 1.0).otherwise(0.0)
    year = math.sqrt(252.0)
    vt = lambda v, t: F.coalesce(F.when(F.col(v) > 0, F.least(t / (F.col(v) * year), F.lit(1.5))), F.lit(0.0))
    d = d.withColumns({"buy_and_hold": F.lit(1.0), "vol_target_12": vt("_v20", 0.12), "vol_target_60": vt("_v60", 0.10), "trend_200": on(F.col("close") > F.col("_m200")),
                       "sma_gate": on(F.col("_m50") > F.col("_m200")), "vol_regime": on(F.col("_v20") <= F.col("_med")), "mom_12_1": on(F.col("_s252") - F.col("_s21") > 0)})
    d = d.withColumns({f"{c}_lag1": F.coalesce(F.lag(c).over(w), F.lit(0.0)) for c in ("sma_gate", "vol_regime", "vol_target_12")})
    return d.drop("_lr", "_v20", "_v60", "_m50", "_m200", "_s252", "_s21", "_med")


def macro_state(dates: DataFrame) -> DataFrame:
    """Risk-on when the curve is in contango, credit is above its 100-date mean and the slope is above -1; unknown is on.

    One row per date, so the ordered window is calendar-bounded.
    """
    w = W.orderBy("date").rowsBetween(-99, 0)
    mean = F.when(F.count("credit").over(w) >= 100, F.avg("credit").over(w))
    yes = lambda c: F.coalesce(c, F.lit(True))
    return dates.withColumn("macro_on", yes(F.col("vix") < F.col("vix3m")) & yes(F.col("credit") > mean) & yes(F.col("slope") > -1.0))


def event_gate(df: DataFrame, flag: str, off_scale: float = 0.0) -> DataFrame:
    """Risk-off and risk-on gates around events and a position scaled down inside the window (flags are known ahead)."""
    f = F.col(flag)
    return df.withColumns({"risk_off_gate": F.when(f, 0.0).otherwise(1.0), "risk_on_gate": F.when(f, 1.0).otherwise(0.0),
                           "vol_target_event": F.col("vol_target_12_lag1") * F.when(f, off_scale).otherwise(1.0)})


def vwap_entry(panel: DataFrame, band: float = 0.01, horizon: int = 3, cost_bps: float = 1.0) -> DataFrame:
    """Long when the close is at least ``band`` under the rolling vwap, with the net forward return of the entry."""
    d = panel.withColumn("primary_position", F.when(F.col("close") <= F.col("vwap") * (1.0 - band), 1.0).otherwise(0.0))
    return d.withColumn("net_forward", div(F.lead("close", horizon).over(by()), "close") - 1.0 - 2.0 * cost_bps / 1e4)


def primary_stats(d: DataFrame, horizon: int = 3) -> DataFrame:
    """Edge of the primary entries and the eligibility of a meta-label on top of it."""
    x = F.when((F.col("primary_position") == 1.0), F.col("net_forward"))
    s = F.coalesce(div(F.avg(x), F.stddev_samp(x)), F.lit(0.0)) * math.sqrt(252.0 / horizon)
    out = d.agg(F.count(x).alias("event_count"), s.alias("net_sharpe"), F.coalesce(F.avg((x > 0).cast("double")), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg(x), F.lit(0.0)).alias("expectancy"))
    return out.withColumn("inverted_superior", -F.col("net_sharpe") > F.col("net_sharpe")).withColumn(
        "eligible", (F.col("net_sharpe") > 0) & (F.col("expectancy") > 0) & (F.col("event_count") >= 200) & ~F.col("inverted_superior"))


def triple_barrier(panel: DataFrame, position: str = "primary_position", vertical: int = 20, take: float = 1.5, stop: float = 1.5, vol_rows: int = 20) -> DataFrame:
    """1 when the side's cumulated log return reaches the profit barrier first, else 0; null without side or volatility.

    The look-ahead is a bounded array of the next ``vertical`` returns folded with an early-stop state.
    """
    w = by()
    d = panel.withColumns({"_lr": F.coalesce(logret("close", 1, w), F.lit(0.0)), "_i": F.row_number().over(w)})
    sd = F.when(F.col("_i") > vol_rows, F.stddev_samp("_lr").over(prior_rows(vol_rows)))
    d = d.withColumns({"_sd": sd, "_ahead": F.collect_list("_lr").over(next_rows(vertical)), "_side": F.signum(position)})
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(-1.0).alias("hit"))

    def step(s: Column, r: Column) -> Column:
        cum = s["cum"] + r * F.col("_side")
        hit = F.when(s["hit"] >= 0, s["hit"]).when(cum >= take * F.col("_sd"), 1.0).when(cum <= -stop * F.col("_sd"), 0.0).otherwise(-1.0)
        return F.struct(cum.alias("cum"), hit.alias("hit"))

    label = F.aggregate("_ahead", start, step, lambda s: F.greatest(s["hit"], F.lit(0.0)))
    return d.withColumn("triple_barrier_label", F.when((F.col("_side") != 0) & F.col("_sd").isNotNull(), label)).drop("_lr", "_i", "_sd", "_ahead", "_side")


def residual_state(df: DataFrame, z: str = "residual_z", entry: float = 1.5, leave: float = 0.5, max_days: int = 20, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean-reversion positions with entry, reversion exit and a time limit: an ordered fold per calendar-bounded key."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        out, pos, held = [], 0.0, 0
        for v in pdf[z].to_numpy(dtype=float):
            known = not np.isnan(v)
            if pos != 0.0:
                held += 1
                if held >= max_days or (known and abs(v) <= leave):
                    pos, held = 0.0, 0
            if pos == 0.0 and known and abs(v) >= entry:
                pos, held = -float(np.sign(v)), 0
            out.append(pos)
        return pdf.assign(position=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", position double"
    return df.groupBy(*key).applyInPandas(fold, schema)


def null_baselines(df: DataFrame, signal: str = "signal", group: Sequence[str] = ("date",), seed: int = 7) -> DataFrame:
    """Inverted, always long/short, random side, random side under the same mask, and the signal shuffled inside its group.

    The shuffle pairs two keyed orders of the group, both numbered without sorting a group in one task.
    """
    from quantloom.operators.ranks import ordinal
    d = stored(df.withColumns({"_u": uniform("date", "symbol", seed=seed), "_u2": uniform("date", "symbol", seed=seed + 1)}))  # the ranks read it four times
    target = ordinal(d, "_u2", "_rb", group, ("symbol",)).select(*group, F.col("_rb").alias("_ra"), F.col(signal).alias("shuffled"))
    out = ordinal(d, "_u", "_ra", group, ("symbol",)).join(target, [*group, "_ra"])
    rnd = F.when(F.col("_u") < 0.5, -1.0).otherwise(1.0)
    return out.withColumns({"inverted": -F.col(signal), "always_long": F.lit(1.0), "always_short": F.lit(-1.0), "random_side": rnd,
                            "same_mask_random": F.when(F.col(signal) != 0, rnd).otherwise(0.0)}).drop("_u", "_u2", "_ra")


def placebo_events(calendar: DataFrame, events: DataFrame, shifts: Sequence[int], seed: int = 11) -> DataFrame:
    """Event dates shifted by k trading rows and as many random dates (date tables, calendar-bounded)."""
    idx = calendar.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")))
    ev = idx.join(events.select("date").distinct(), "date")
    out = None
    for k in shifts:
        s = ev.select((F.col("_i") + k).alias("_i")).join(idx, "_i").select(F.lit(f"shift_{k}").alias("calendar"), "date")
        out = s if out is None else out.unionByName(s)
    n = ev.agg(F.count(F.lit(1)).alias("_n"))
    r = idx.withColumn("_o", F.row_number().over(W.orderBy(uniform("date", seed=seed), "date"))).crossJoin(n).filter("_o <= _n")  # one-row side
    return out.unionByName(r.select(F.lit("random").alias("calendar"), "date"))
