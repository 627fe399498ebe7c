"""Daily-bar features and labels as window expressions.

Each builder takes a (symbol, date, open, high, low, close, volume) panel and adds columns.  All
windows of a builder share one partition and order, so chaining builders needs one shuffle and one
sort by symbol.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import (by, clip, col, div, full, iso_week, last_rows, logret, pct_change,
                                         prior_rows, roll, so_far)
from quantloom.functions.noise import gaussian
from quantloom.functions.rolling import rolling, rolling_pairs
from quantloom.operators.ranks import scaled_ranks, with_group_stats

LN2 = math.log(2.0)


def returns_momentum(panel: DataFrame, horizons: Sequence[int] = (1, 2, 5, 10, 20, 60, 120, 252),
                     skip5: Sequence[int] = (60, 120, 252)) -> DataFrame:
    """Log returns over h rows, cumulative returns that skip the last five rows, five-row reversal."""
    w = by()
    cols = {f"log_return_{h}": logret("close", h, w) for h in horizons}
    cols |= {f"cumulative_return_{h}_skip5": F.log(F.lag("close", 5).over(w)) - F.log(F.lag("close", h).over(w)) for h in skip5}
    if 5 in horizons:
        cols["mean_reversion_5"] = -logret("close", 5, w)
    return panel.withColumns(cols)


def lag_features(df: DataFrame, columns: Sequence[str], lags: Sequence[int], key: Sequence[str] = ("symbol",),
                 time: Sequence[str] = ("date",)) -> DataFrame:
    w = by(key, time)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def rolling_features(df: DataFrame, columns: Sequence[str], windows: Sequence[int], key: Sequence[str] = ("symbol",),
                     time: Sequence[str] = ("date",)) -> DataFrame:
    """Full-window rolling mean and sample deviation."""
    specs = {f"{c}_mean{n}": ("avg", c, n) for c in columns for n in windows}
    return rolling(df, specs | {f"{c}_std{n}": ("std", c, n) for c in columns for n in windows}, key, time)


def volatility(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), range_window: int = 20, vov_window: int = 60) -> DataFrame:
    """Close-to-close, Parkinson and Garman-Klass volatility, and the volatility of volatility."""
    hl2 = F.pow(F.log(F.col("high") / F.col("low")), 2)
    gk = 0.5 * hl2 - (2 * LN2 - 1) * F.pow(F.log(F.col("close") / F.col("open")), 2)
    d = panel.withColumns({"_r1": logret("close", 1, by()), "_hl2": hl2, "_gk": clip(gk, 0.0)})
    d = rolling(d, {f"realized_vol_{n}": ("std", "_r1", n) for n in windows} | {"_pk": ("avg", "_hl2", range_window), "_gm": ("avg", "_gk", range_window)})
    d = d.withColumns({f"parkinson_vol_{range_window}": F.sqrt(F.col("_pk") / (4 * LN2)), f"garman_klass_vol_{range_window}": F.sqrt("_gm")})
    if 20 in windows:
        d = rolling(d, {f"vol_of_vol_{vov_window}": ("std", "realized_vol_20", vov_window)})
    return d.drop("_r1", "_hl2", "_gk", "_pk", "_gm")


def rolling_vol(panel: DataFrame, window: int, estimator: str, name: str = "vol") -> DataFrame:
    """One selectable volatility estimator: close_to_close, parkinson or rogers_satchell."""
    o, h, lo, c = (F.log(F.col(x)) for x in ("open", "high", "low", "close"))
    if estimator == "close_to_close":
        d = panel.withColumn("_x", logret("close", 1, by()))
        return rolling(d, {name: ("std", "_x", window)}).drop("_x")
    if estimator == "parkinson":
        d = panel.withColumn("_x", F.pow(h - lo, 2))
        return rolling(d, {"_m": ("avg", "_x", window)}).withColumn(name, F.sqrt(F.col("_m") / (4 * LN2))).drop("_x", "_m")
    if estimator == "rogers_satchell":
        d = panel.withColumn("_x", (h - c) * (h - o) + (lo - c) * (lo - o))
        return rolling(d, {"_m": ("avg", "_x", window)}).withColumn(name, F.sqrt(clip("_m", 0.0))).drop("_x", "_m")
    raise ValueError(f"unknown estimator {estimator!r}")


def microstructure(panel: DataFrame, window: int = 20) -> DataFrame:
    """Amihud illiquidity, Roll spread, price-impact slope, gaps and close location.

    The Roll and impact moments are population products over a sample variance, kept as mixed.
    """
    w, n = by(), window
    d = panel.withColumns({"_r": logret("close", 1, w), "_dv": F.col("close") * F.col("volume")})
    d = d.withColumns({"_rl": F.lag("_r").over(w), "_ill": F.abs("_r") / clip("_dv", 1e-9), "_s": F.signum("_r") * F.col("_dv"),
                       "_a": F.abs("_r")})
    d = d.withColumns({"_xy": F.col("_r") * F.col("_rl"), "_as": F.col("_a") * F.col("_s")})
    auto = roll(F.avg, "_xy", n) - roll(F.avg, "_r", n) * roll(F.avg, "_rl", n)
    impact = roll(F.avg, "_as", n) - roll(F.avg, "_a", n) * roll(F.avg, "_s", n)
    lo, hi = roll(F.min, "low", n), roll(F.max, "high", n)
    d = d.withColumns({"_auto": auto, "_imp": impact, "_vs": roll(F.var_samp, "_s", n), "_lo": lo, "_hi": hi})
    return d.withColumns({
        f"amihud_illiq_{n}": roll(F.avg, "_ill", n),
        f"roll_spread_{n}": F.when(F.col("_auto") < 0, 2.0 * F.sqrt(-F.col("_auto"))),
        f"kyle_proxy_signed_volume_{n}": F.col("_imp") / clip("_vs", 1e-18),
        "overnight_gap": F.log(F.col("open") / F.lag("close").over(w)),
        "intraday_return": F.log(F.col("close") / F.col("open")),
        f"close_location_{n}": (F.col("close") - F.col("_lo")) / clip(F.col("_hi") - F.col("_lo"), 1e-9),
    }).drop("_r", "_dv", "_rl", "_ill", "_s", "_a", "_xy", "_as", "_auto", "_imp", "_vs", "_lo", "_hi")


def volume_liquidity(panel: DataFrame, window: int = 20) -> DataFrame:
    n = window
    d = panel.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    d = d.withColumn("_ldv", F.log(F.col("dollar_volume") + 1.0))
    return d.withColumns({
        f"log_dollar_volume_{n}d": roll(F.avg, "_ldv", n),
        f"volume_zscore_{n}d": (F.col("volume") - roll(F.avg, "volume", n)) / clip(roll(F.stddev_samp, "volume", n), 1e-9),
    }).drop("_ldv")


def lagged_adv(panel: DataFrame, window: int = 20) -> DataFrame:
    """Rolling median dollar volume, known one row later."""
    d = panel.withColumn("_dv", F.col("close") * F.col("volume"))
    d = d.withColumn("_med", full(window, F.percentile("_dv", F.lit(0.5)), "_dv", last_rows(window)))
    return d.withColumn("adv_20d_dollar_lag1", F.lag("_med").over(by())).drop("_dv", "_med")


def market_regime(panel: DataFrame, vix: DataFrame | None = None, index_close: DataFrame | None = None, key: str = "date") -> DataFrame:
    """Cross-sectional dispersion, its 20-date mean, implied-vol level with proxy flag, index features.

    The date-level table is bounded by the calendar, so its ordered windows run on few rows and the
    result is broadcast back to the panel.
    """
    d = panel.withColumn("_r1", logret("close", 1, by()))
    dates = d.groupBy(key).agg(F.stddev_samp("_r1").alias("cross_sectional_dispersion"))
    w = W.orderBy(key).rowsBetween(-19, 0)
    dates = dates.withColumn("cross_sectional_vol_20", full(20, F.avg("cross_sectional_dispersion"), "cross_sectional_dispersion", w))
    if vix is not None:
        dates = dates.join(vix.select(key, F.col("vix_close").alias("_vix")), key, "left")
    else:
        dates = dates.withColumn("_vix", F.lit(None).cast("double"))
    dates = dates.withColumn("vix_close", F.coalesce("_vix", "cross_sectional_vol_20")).withColumn("vix_is_proxy", F.col("_vix").isNull()).drop("_vix")
    if index_close is not None:
        o = W.orderBy(key)
        ix = index_close.withColumn("_r", logret("index_close", 1, o))
        ix = ix.select(key, logret("index_close", 5, o).alias("index_log_return_5"),
                       full(20, F.stddev_samp("_r"), "_r", w).alias("index_realized_vol_20"))
        dates = dates.join(ix, key, "left")
    return d.drop("_r1").join(F.broadcast(dates), key, "left")


def forward_labels(panel: DataFrame, close_tr: str, vol: str, universe: str) -> DataFrame:
    """Next-row return, volatility-normalised, then demeaned inside the universe of the date."""
    d = panel.withColumn("y_raw", div(F.lead(close_tr, 1).over(by()), close_tr) - 1.0)
    d = d.withColumn("y_vn", F.col("y_raw") / clip(vol, 1e-9))
    d = with_group_stats(d, ["date"], calendar_sized=True, _m=F.avg(F.when(F.col(universe), F.col("y_vn"))))
    return d.withColumn("y_xs", F.when(F.col(universe), F.col("y_vn") - F.col("_m"))).drop("_m")


def horizon_labels(panel: DataFrame, horizons: Sequence[int], price: str = "close", key: Sequence[str] = ("symbol",),
                   time: Sequence[str] = ("date",)) -> DataFrame:
    """Forward simple returns and an up flag for many horizons."""
    w = by(key, time)
    d = panel.withColumns({f"future_return_{h}": div(F.lead(price, h).over(w), price) - 1.0 for h in horizons})
    return d.withColumns({f"direction_up_{h}": (F.col(f"future_return_{h}") > 0).cast("byte") for h in horizons})


def past_only_ohlcv(panel: DataFrame, windows: Sequence[int] = (5, 20, 60), horizons: Sequence[int] = (1,)) -> DataFrame:
    """Return, gap, range and rolling statistics with the smaller minimum max(2, min(n, 5)), plus labels."""
    w = by()
    d = panel.withColumns({
        "return_1": pct_change("close", 1, w), "gap_return_1": div("open", F.lag("close").over(w)) - 1.0,
        "open_close_return": div("close", "open") - 1.0, "log_return_1": logret("close", 1, w),
        "high_low_range": div(F.col("high") - F.col("low"), "close"), "dollar_volume": F.col("volume") * F.col("close"),
        "volume_change_1": pct_change("volume", 1, w)})
    for n in windows:
        d = rolling(d, {f"realized_vol_{n}": ("std", "log_return_1", n), f"return_{n}_mean": ("avg", "return_1", n)}, least=max(2, min(n, 5)))
    return horizon_labels(d, horizons)


def minute_features(panel: DataFrame, horizon: int = 15, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Short-horizon bar features: returns, vwap deviation, log activity, volatility, forward target."""
    w = by(key, time)
    d = panel.withColumns({f"ret{n}": pct_change("close", n, w) for n in (1, 5, 15, 60)} | {
        "vwap_dev": div("close", "vwap") - 1.0, "log_volume": F.log1p("volume"), "log_count": F.log1p("count")})
    d = rolling(d, {"vol15": ("std", "ret1", 15), "vol60": ("std", "ret1", 60)}, key, time)
    return d.withColumn("future_return", div(F.lead("close", horizon).over(w), "close") - 1.0)


CHARACTERISTICS = ("momentum_1m momentum_3m momentum_6m momentum_12m_skip_1m reversal_1d reversal_5d reversal_1m realized_vol_20 "
                   "realized_vol_60 beta_to_market_60 beta_to_market_252 idiosyncratic_vol_60 dollar_volume_20d amihud_illiq_20 "
                   "max_daily_return_20 drawdown_60 drawdown_252 volume_shock_zscore_20 close_location_20").split()


def characteristics(panel: DataFrame) -> DataFrame:
    """The nineteen price and volume characteristics of the cross-sectional model."""
    d = panel.withColumns({"log_ret": logret("close", 1, by()), "dollar_volume": F.col("close") * F.col("volume"),
                           "_loc": (F.col("close") - F.col("low")) / clip(F.col("high") - F.col("low"), 1e-9)})
    d = _with_market(d.withColumn("_ill", div(F.abs("log_ret"), "dollar_volume")))
    d = rolling(d, {
        "momentum_1m": ("sum", "log_ret", 21), "momentum_3m": ("sum", "log_ret", 63), "momentum_6m": ("sum", "log_ret", 126),
        "_sum252": ("sum", "log_ret", 252), "reversal_5d": ("sum", "log_ret", 5), "realized_vol_20": ("std", "log_ret", 20),
        "realized_vol_60": ("std", "log_ret", 60), "dollar_volume_20d": ("avg", "dollar_volume", 20), "amihud_illiq_20": ("avg", "_ill", 20),
        "max_daily_return_20": ("max", "log_ret", 20), "_hi60": ("max", "close", 60), "_hi252": ("max", "close", 252),
        "_va": ("avg", "volume", 20), "_vs": ("std", "volume", 20), "close_location_20": ("avg", "_loc", 20)}, pairs=_market_pairs(BETA_SPEC))
    d = d.withColumns({
        "momentum_12m_skip_1m": F.col("_sum252") - F.col("momentum_1m"), "reversal_1d": F.col("log_ret"), "reversal_1m": F.col("momentum_1m"),
        "drawdown_60": div("close", "_hi60") - 1.0, "drawdown_252": div("close", "_hi252") - 1.0,
        "volume_shock_zscore_20": div(F.col("volume") - F.col("_va"), "_vs")})
    return _betas(d.drop("_loc", "_ill", "_sum252", "_hi60", "_hi252", "_va", "_vs"), BETA_SPEC, 60).drop("mkt_ret")


BETA_SPEC = ((60, 30), (252, 100))


def _with_market(d: DataFrame) -> DataFrame:
    return with_group_stats(d, ["date"], calendar_sized=True, mkt_ret=F.avg("log_ret")).withColumn("_i", F.row_number().over(by()))


def _market_pairs(spec: Sequence[tuple[int, int]]) -> dict:
    return {"_pair": ("log_ret", "mkt_ret", [n for n, _ in spec], 1)}


def _betas(d: DataFrame, spec: Sequence[tuple[int, int]], idio: int) -> DataFrame:
    for n, least in spec:
        enough = (F.col(f"_pair_n_{n}") >= least) & (F.col("_i") > n)
        d = d.withColumn(f"beta_to_market_{n}", F.when(enough, div(f"_pair_cov_{n}", f"_pair_vy_{n}")))
        if n == idio:
            resid = F.col(f"_pair_vx_{n}") - F.col(f"beta_to_market_{n}") * F.col(f"_pair_cov_{n}")
            d = d.withColumn(f"idiosyncratic_vol_{n}", F.when(enough, F.sqrt(F.greatest(resid, F.lit(0.0)))))
    return d.drop("_i", *[c for c in d.columns if c.startswith("_pair_")])


def market_beta(panel: DataFrame, spec: Sequence[tuple[int, int]] = BETA_SPEC, idio: int = 60) -> DataFrame:
    """Market beta over rows t-n … t-1 (at least ``least`` pairs, from row index n on) and idiosyncratic volatility.

    The residual variance follows from the same moments: var(r) - beta * cov(r, m).
    """
    d = panel if "log_ret" in panel.columns else panel.withColumn("log_ret", logret("close", 1, by()))
    return _betas(rolling(_with_market(d), {}, pairs=_market_pairs(spec)), spec, idio)


def rolling_index_beta(df: DataFrame, y: str, x: str, window: int, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Population covariance over sample variance, both on full windows."""
    d = rolling_pairs(df, y, x, [window], key, time, prefix="_index")
    beta = div(F.col(f"_index_cov_{window}") * ((window - 1) / window), f"_index_vy_{window}")
    return d.withColumn("beta", F.when(F.col(f"_index_n_{window}") >= window, beta)).drop(*[f"_index_{k}_{window}" for k in ("n", "cov", "vx", "vy")])


def trend_fingerprint(panel: DataFrame, windows: Sequence[int] = (20, 60, 120, 252)) -> DataFrame:
    """OLS trend of the log close on time: direction, |slope|, R², and spikiness max|r|/sd of the window.

    Over n consecutive rows the time index has the fixed sum of squares n(n²-1)/12, so slope and R²
    follow from running sums of y, y² and t·y.
    """
    w = by()
    d = panel.withColumns({"_t": F.row_number().over(w).cast("double"), "_lc": F.log("close"), "_r": F.coalesce(logret("close", 1, w), F.lit(0.0))})
    d = d.withColumn("_ar", F.abs("_r"))
    d = rolling(d, {f"_sd{n}": ("std", "_r", n) for n in windows} | {f"_mx{n}": ("max", "_ar", n) for n in windows}, pairs={"_pair": ("_t", "_lc", windows, 0)})
    for n in windows:
        ready = F.col(f"_pair_n_{n}") >= n
        tss = n * (n * n - 1) / 12.0 / (n - 1)
        slope = F.col(f"_pair_cov_{n}") / tss
        r2 = F.coalesce(div(slope * slope * tss, f"_pair_vy_{n}"), F.lit(0.0))
        d = d.withColumns({f"trend_direction_{n}": F.when(ready, F.signum(slope)), f"trend_strength_{n}": F.when(ready, F.abs(slope)),
                           f"trend_linearity_r2_{n}": F.when(ready, clip(r2, 0.0, 1.0)),
                           f"spikiness_{n}": F.when(ready, F.coalesce(div(f"_mx{n}", f"_sd{n}"), F.lit(0.0)))})
    return d.drop("_t", "_lc", "_r", "_ar", *[c for c in d.columns if c.startswith(("_pair_", "_sd", "_mx"))])


def vwap_proxy(panel: DataFrame, window: int = 5) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    d = panel.withColumns({"_tpv": tp * F.col("volume")})
    return d.withColumn("vwap", div(roll(F.sum, "_tpv", window), roll(F.sum, "volume", window))).drop("_tpv")


def index_state_features(panel: DataFrame) -> DataFrame:
    """Single-index state features (annualised volatilities); rows with any incomplete window are dropped."""
    w, year = by(), math.sqrt(252.0)
    d = panel.withColumns({"log_return": logret("close", 1, w), "_rg": div(F.col("high") - F.col("low"), "close")})
    d = rolling(d, {"_v21": ("std", "log_return", 21), "_v63": ("std", "log_return", 63), "_h60": ("max", "close", 60), "_h252": ("max", "close", 252),
                    "range_pct_20": ("avg", "_rg", 20), "_va": ("avg", "volume", 20), "_vs": ("std", "volume", 20)})
    out = {"realized_vol_21": F.col("_v21") * year, "realized_vol_63": F.col("_v63") * year, "drawdown_60": div("close", "_h60") - 1.0,
           "drawdown_252": div("close", "_h252") - 1.0, "trend_slope_50": logret("close", 50, w) / 50.0, "trend_slope_200": logret("close", 200, w) / 200.0,
           "volume_zscore_20": (F.col("volume") - F.col("_va")) / clip("_vs", 1e-9)}
    return d.withColumns(out).select("symbol", "date", "log_return", "range_pct_20", *out).dropna()


def meta_label_features(panel: DataFrame, lookback: int = 20, horizon: int = 5) -> DataFrame:
    """Features of the meta-label model with the default primary side (sign of the lookback return)."""
    w = by()
    d = panel.withColumn("log_return_1", logret("close", 1, w))
    d = d.withColumns({"log_return_5": logret("close", 5, w), "log_return_lookback": logret("close", lookback, w),
                       "future_return_horizon": div(F.lead("close", horizon).over(w), "close") - 1.0,
                       "realized_vol_20": roll(F.stddev_samp, "log_return_1", 20),
                       "volume_z_20": (F.col("volume") - roll(F.avg, "volume", 20)) / (roll(F.stddev_samp, "volume", 20) + 1e-12)})
    return d.withColumn("primary_position", F.coalesce(F.signum("log_return_lookback"), F.lit(0.0)))


def total_return(panel: DataFrame, dividends: DataFrame, inverse: bool = False) -> DataFrame:
    """Reinvest dividends into OHLC (or take the reinvestment out again with ``inverse``)."""
    d = panel.join(dividends.withColumnRenamed("ex_date", "date"), ["symbol", "date"], "left")
    prior = F.lag("close").over(by())
    factor = F.when(prior > 0, 1.0 + F.coalesce("dividend_per_share", F.lit(0.0)) / prior).otherwise(1.0)
    d = d.withColumn("_f", factor).withColumn("_cf", F.product("_f").over(so_far()))
    op = (lambda c: F.col(c) / F.col("_cf")) if inverse else (lambda c: F.col(c) * F.col("_cf"))
    return d.withColumns({c: op(c) for c in ("open", "high", "low", "close")}).drop("dividend_per_share", "_f", "_cf")


def price_series(panel: DataFrame, dividends: DataFrame, source_is_total_return: bool = False) -> DataFrame:
    """Tradable and total-return (``*_tr``) series side by side, one pass."""
    base = total_return(panel, dividends, inverse=True) if source_is_total_return else panel
    tr = total_return(base, dividends).select("symbol", "date", *[F.col(c).alias(f"{c}_tr") for c in ("open", "high", "low", "close")])
    return base.join(tr, ["symbol", "date"])


def dividend_returns(panel: DataFrame, dividends: DataFrame) -> DataFrame:
    """Price return and dividend-inclusive return per day."""
    d = panel.join(dividends.withColumnRenamed("ex_date", "date"), ["symbol", "date"], "left")
    prior = F.lag("close").over(by())
    cash = F.coalesce("dividend_per_share", F.lit(0.0))
    return d.withColumns({"price_return": div("close", prior) - 1.0, "total_return": div(F.col("close") + cash, prior) - 1.0}).drop("dividend_per_share")


def ewma(df: DataFrame, x: str, span: float, name: str, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Exponential mean with bias-adjusted weights over the rows so far."""
    return ewmas(df, {name: (x, span)}, key, time)


def ewmas(df: DataFrame, specs: dict[str, tuple[str, float]], key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """Several exponential means at once, linear in the rows and without Python.

    With k = 1-a the weighted sum is ``num_t = x_t + k num_{t-1}``.  The closed form of the recursion
    scales by k^-i, which overflows on long series, so rows are cut into blocks of B rows with
    k^B <= 1e-17: inside a block the scaled running sum is safe, and of the past only the value at
    the end of the previous block still counts.  The sum of weights has a closed form.
    """
    w = by(key, time)
    d = df.withColumn("_i", F.row_number().over(w) - 1)
    keeps = {n: 1.0 - 2.0 / (span + 1.0) for n, (_, span) in specs.items()}
    sizes = {n: max(2, math.ceil(math.log(1e-17) / math.log(k))) for n, k in keeps.items()}
    pos = {n: F.col("_i") % b for n, b in sizes.items()}
    power = lambda n, e: F.pow(F.lit(keeps[n]), e)
    d = d.withColumns({f"_b{b}": F.floor(F.col("_i") / b) for b in set(sizes.values())} | {f"_z_{n}": F.col(x) * power(n, -pos[n]) for n, (x, _) in specs.items()})
    d = d.withColumns({f"_p_{n}": F.sum(f"_z_{n}").over(W.partitionBy(*key, f"_b{sizes[n]}").orderBy(*time).rowsBetween(W.unboundedPreceding, 0)) * power(n, pos[n]) for n in specs})
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({f"_e_{n}": F.last(F.when(pos[n] == sizes[n] - 1, F.col(f"_p_{n}")), ignorenulls=True).over(before) for n in specs})
    out = {n: (F.col(f"_p_{n}") + F.coalesce(F.col(f"_e_{n}"), F.lit(0.0)) * power(n, pos[n] + 1)) / ((1.0 - power(n, F.col("_i") + 1)) / (1.0 - keeps[n])) for n in specs}
    return d.withColumns(out).drop("_i", *[f"_b{b}" for b in set(sizes.values())], *[f"_{k}_{n}" for k in "zpe" for n in specs])


def rolling_mad(df: DataFrame, x: str, n: int, name: str) -> DataFrame:
    """Rolling mean absolute deviation from the window mean (bounded window array)."""
    d = df.withColumns({"_mu": roll(F.avg, x, n), "_w": F.collect_list(x).over(last_rows(n))})
    mad = F.aggregate(F.transform("_w", lambda v: F.abs(v - F.col("_mu"))), F.lit(0.0), lambda a, v: a + v) / float(n)
    return d.withColumn(name, F.when(F.col("_mu").isNotNull(), mad)).drop("_mu", "_w")


def days_since_extreme(df: DataFrame, n: int) -> DataFrame:
    """Rows since the first occurrence of the rolling high and low, from row index n on (0-based)."""
    w, f = by(), last_rows(n)
    d = df.withColumn("_rn", F.row_number().over(w))
    hi = F.max(F.struct(F.col("high").alias("v"), (-F.col("_rn")).alias("r"))).over(f)["r"]
    lo = F.min(F.struct(F.col("low").alias("v"), F.col("_rn").alias("r"))).over(f)["r"]
    on = F.col("_rn") > n
    return d.withColumns({"since_high": F.when(on, F.col("_rn") + hi), "since_low": F.when(on, F.col("_rn") - lo)}).drop("_rn")


def drawdown(df: DataFrame, ret: str, key: Sequence[str], time: Sequence[str], additive: bool = False) -> DataFrame:
    """Equity, running peak and drawdown; one row per key and period, so calendar-bounded."""
    f = so_far(key, time)
    equity = F.sum(ret).over(f) if additive else F.product(1.0 + F.col(ret)).over(f)
    d = df.withColumn("equity", equity).withColumn("peak", F.max("equity").over(f))
    return d.withColumn("drawdown", F.col("equity") - F.col("peak") if additive else div("equity", "peak") - 1.0)


def underwater_runs(df: DataFrame, key: Sequence[str], time: Sequence[str]) -> DataFrame:
    """Max drawdown and longest run below the running peak (gaps and islands over ``drawdown``)."""
    f = so_far(key, time)
    d = df.withColumn("_at_peak", F.sum((F.col("drawdown") >= 0).cast("int")).over(f))
    runs = d.groupBy(*key, "_at_peak").agg(F.sum((F.col("drawdown") < 0).cast("int")).alias("run"), F.min("drawdown").alias("dd"))
    return runs.groupBy(*key).agg(F.min("dd").alias("max_drawdown"), F.max("run").alias("longest_underwater"))


def held(x: str | Column, n: int, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> Column:
    """Minimum holding: the last non-zero value of the last n rows, else 0."""
    nz = F.when(col(x) != 0, col(x))
    return F.coalesce(F.last(nz, ignorenulls=True).over(last_rows(n, key, time)), F.lit(0.0))


def forward_fill(x: str | Column, key: Sequence[str], time: Sequence[str]) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(key, time))


def weekly_hold(df: DataFrame, weight: str, key: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """The week's first weight on every day of the ISO week."""
    y, wk = iso_week(date)
    d = df.withColumn("_y", y).withColumn("_w", wk)
    first = F.first(weight).over(W.partitionBy(*key, "_y", "_w").orderBy(date))
    return d.withColumn(f"{weight}_weekly", first).drop("_y", "_w")


def variance_premium(dates: DataFrame, n: int = 21, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Implied minus realised annual variance with term-structure ratios and 60-row z-scores.

    Needs ``close`` and ``vix``; ``vix9d``, ``vix3m``, ``vvix``, ``skew`` and ``vxn`` add their columns when present.
    """
    d = dates.withColumn("_r", logret("close", 1, by(key)))
    d = rolling(d.withColumn("_r2", F.col("_r") * F.col("_r")), {"_s": ("sum", "_r2", n)}, key)
    d = d.withColumns({"realized_var_annual": F.col("_s") * (252.0 / n), "implied_var_annual": F.pow(F.col("vix") / 100.0, 2)})
    d = d.withColumn("vrp", F.col("implied_var_annual") - F.col("realized_var_annual"))
    for source, name in {"vix9d": "term_9d_30d", "vix3m": "term_30d_3m", "vvix": "vvix_to_vix", "vxn": "vxn_to_vix"}.items():
        if source in dates.columns:
            d = d.withColumn(name, div(source, "vix"))
    skew = "skew" in dates.columns
    d = rolling(d, {"_m": ("avg", "vrp", 60), "_d": ("std", "vrp", 60)} | ({"_km": ("avg", "skew", 60), "_kd": ("std", "skew", 60)} if skew else {}), key)
    if skew:
        d = d.withColumn("skew_z60", (F.col("skew") - F.col("_km")) / clip("_kd", 1e-6))
    return d.withColumn("vrp_z60", (F.col("vrp") - F.col("_m")) / clip("_d", 1e-9)).drop("_r", "_r2", "_s", "_m", "_d", "_km", "_kd")


def implied_vol_features(dates: DataFrame) -> DataFrame:
    """Volatility-unit premium and option proxies; the fallback flag says that no implied column was given."""
    d = dates
    if "vix" in d.columns:
        return d.withColumns({"vrp_vol": F.col("vix") / 100.0 - F.sqrt("realized_var_annual"), "options_fallback": F.lit(False)})
    return d.withColumns({"vrp_vol": F.lit(None).cast("double"), "options_fallback": F.lit(True)})


# Earnings seasons as inclusive (month*100+day) ranges.
EARNINGS_SEASONS = ((115, 215), (415, 515), (715, 815), (1015, 1115))


def event_features(bars: DataFrame, events: DataFrame, key: Sequence[str] = ("symbol",), far: int = 9999) -> DataFrame:
    """Distance to the next and the last event in trading rows, window flags and calendar flags.

    ``events`` is a list of dates, bounded by the calendar, so it is broadcast.  An event on a day
    without a bar of the symbol does not count.
    """
    w = by(key)
    d = bars.join(F.broadcast(events.select("date").distinct().withColumn("_ev", F.lit(1))), "date", "left")
    d = d.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col("_ev") == 1, F.col("_i"))
    ahead = F.min(at).over(w.rowsBetween(0, W.unboundedFollowing))
    behind = F.max(at).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumns({"days_to_next_event": F.least(F.coalesce(ahead - F.col("_i"), F.lit(far)), F.lit(far)),
                       "days_since_last_event": F.least(F.coalesce(F.col("_i") - behind, F.lit(far)), F.lit(far))})
    nearest = F.least("days_to_next_event", "days_since_last_event")
    lead, md = F.lead("date").over(w), F.month("date") * 100 + F.dayofmonth("date")
    season = F.lit(False)
    for lo, hi in EARNINGS_SEASONS:
        season = season | md.between(lo, hi)
    return d.withColumns({
        "event_t0": F.coalesce(F.col("_ev") == 1, F.lit(False)), "event_tm1": F.col("days_to_next_event") == 1,
        "event_tp1": F.col("days_since_last_event") == 1, "event_win2": nearest <= 2, "event_win5": nearest <= 5,
        "is_month_end": lead.isNull() | (F.trunc(lead, "MM") != F.trunc("date", "MM")),
        "is_quarter_end": lead.isNull() | (F.trunc(lead, "quarter") != F.trunc("date", "quarter")),
        "in_earnings_season": season}).drop("_ev", "_i")


def noise_sentinel(panel: DataFrame, seed: int = 42, name: str = "noise_sentinel") -> DataFrame:
    return panel.withColumn(name, gaussian("date", "symbol", seed=seed))


def build_features(panel: DataFrame, universe: str = "in_index", seed: int = 42) -> DataFrame:
    """The composed daily feature set: symbol windows first, then one date stage, ranks and noise."""
    d = volume_liquidity(microstructure(volatility(returns_momentum(panel))))
    d = market_regime(d)
    d = scaled_ranks(d, ["log_return_20", "realized_vol_20", "volume_zscore_20d"], universe)
    return noise_sentinel(d, seed)
