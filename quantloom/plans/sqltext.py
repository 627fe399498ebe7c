"""Text fragments for the comparison SQL."""

from __future__ import annotations


def g(agg: str, x: str, n: int, least: int | None = None, w: str | None = None) -> str:
    """Guarded rolling aggregate over the named window ``w<n>``."""
    w = w or f"w{n}"
    return f"CASE WHEN count({x}) OVER {w} >= {n if least is None else least} THEN {agg}({x}) OVER {w} END"


def windows(*sizes: int, key: str = "symbol", time: str = "date") -> str:
    parts = [f"wk AS (PARTITION BY {key} ORDER BY {time})"] if key else [f"wk AS (ORDER BY {time})"]
    head = f"PARTITION BY {key} " if key else ""
    parts += [f"w{n} AS ({head}ORDER BY {time} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes]
    return "WINDOW " + ", ".join(parts)


def lr(x: str = "close", n: int = 1) -> str:
    return f"ln({x}) - ln(lag({x}, {n}) OVER wk)"


def prior(n: int, key: str = "symbol", time: str = "date") -> str:
    return f"(PARTITION BY {key} ORDER BY {time} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


SOFAR = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def norm_cdf(x: str) -> str:
    """Standard normal distribution by its power series (|x| below 7)."""
    return (f"(0.5 + exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), "
            f"lambda k: sign({x}) * exp((2 * k + 1) * ln(greatest(abs({x}), 1e-12)) - ((k + 1) * ln(2) + lgamma(k + 1.5) - 0.5 * ln(pi()))))))")


def _horner(coefficients: list[float], r: str) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {r} + {c!r})"
    return out


# Rational approximation of the normal quantile (Wichura 1988, algorithm AS 241).
_A = [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610]
_C = [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4]
_D = [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9]


def norm_ppf(p: str) -> str:
    """Standard normal quantile for p between 1e-11 and 1 - 1e-11."""
    q, r1 = f"(({p}) - 0.5)", f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))"
    r2 = f"(sqrt(-ln(least({p}, 1 - ({p})))) - 1.6)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(_A, r1)} / {_horner(_B, r1)} ELSE sign({q}) * {_horner(_C, r2)} / {_horner(_D, r2)} END)"


UNIVERSE = """ub AS (SELECT n_regionkey AS symbol, date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume
  FROM bars JOIN supplier ON symbol = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def family_sql(n: int, rel: str = "ub") -> tuple[str, dict[str, tuple[str, str]]]:
    """CTEs and the (a, b) indicator expressions of every family without exponential means, for lookback n."""
    fast = max(2, n // 4)
    r = f"r{n} AS (SELECT *, {lr()} AS r, close - lag(close) OVER wk AS d, lag(close) OVER wk AS pc, row_number() OVER wk AS i, (high + low + close) / 3 AS tp FROM {rel} {windows()})"
    s = f"""s{n} AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gn, CASE WHEN d < 0 THEN -d ELSE 0 END AS ls, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, high - low AS hl FROM r{n})"""
    wins = windows(*sorted({n, fast}))
    t = f"""t{n} AS (SELECT symbol, date, close, i, tp, {lr(n=n)} AS mom, ln(lag(close, {n}) OVER wk) - ln(lag(close, {2 * n}) OVER wk) AS lm, ln(lag(close, 5) OVER wk) - ln(lag(close, {n}) OVER wk) AS ms, close - lag(close, {n}) OVER wk AS ch, close / lag(close, {n}) OVER wk - 1 AS roc,
  {g('avg', 'close', n)} AS ma, {g('avg', 'close', fast)} AS mf, {g('stddev_samp', 'close', n)} AS sd, {g('stddev_samp', 'r', n)} AS vol, {g('avg', 'r', n)} AS rm, {g('max', 'high', n)} AS hh, {g('min', 'low', n)} AS ll, {g('max', 'close', n)} AS cx, {g('min', 'close', n)} AS cn,
  {g('avg', 'gn', n)} AS ag, {g('avg', 'ls', n)} AS al, {g('avg', 'hl', n)} AS hla, {g('avg', 'tr', n)} AS atr, {g('avg', 'tp', n)} AS tpm, list(tp) OVER w{n} AS tl, arg_max(i, (high, -i)) OVER w{n} AS ih, arg_min(i, (low, i)) OVER w{n} AS il FROM s{n} {wins}),
u{n} AS (SELECT *, lag(hh) OVER wk AS hp, lag(ll) OVER wk AS lp, CASE WHEN tpm IS NOT NULL THEN list_sum(list_transform(tl, lambda v: abs(v - tpm))) / {n} END AS md FROM t{n} {windows()})"""
    e = {"TS_MOMENTUM": ("mom", "NULL"), "LAGGED_MOMENTUM": ("lm", "NULL"), "MA_CROSSOVER": ("(mf - ma) / ma", "NULL"), "DONCHIAN_BREAKOUT": ("hp", "lp"), "BOLLINGER_REVERT": ("ma", "sd"), "BOLLINGER_BREAKOUT": ("ma", "sd"),
         "RSI_MEANREVERT": ("100 - 100 / (1 + ag / greatest(al, 1e-9))", "NULL"), "VOLTGT_MOMENTUM": ("mom", "vol"), "ZSCORE_MEANREVERT": ("(close - ma) / greatest(sd, 1e-9)", "NULL"),
         "AROON": (f"CASE WHEN i > {n} THEN (ih - il) / {n} * 100.0 END", "NULL"), "STOCHASTIC": ("100 * (close - ll) / greatest(hh - ll, 1e-9)", "NULL"), "ROC": ("roc", "NULL"), "CCI": ("(tp - tpm) / (0.015 * greatest(md, 1e-9))", "NULL"),
         "KELTNER_BREAKOUT": ("ma", "hla"), "VOLMANAGED_MOMENTUM": ("mom", "vol"), "ATR_TRAILING_TREND": ("ch", "atr"), "ROLLING_SHARPE_MOM": ("rm / (vol + 1e-12)", "NULL"),
         "RANGE_OSCILLATOR": ("CASE WHEN cx > cn THEN (close - cn) / (cx - cn) * 2 - 1 ELSE 0 END", "NULL"), "MOM_SKIP": ("ms", "NULL")}
    return ", ".join((r, s, t)), e


def signal_sql(lookbacks: list[int], thresholds: list[float], rel: str = "ub") -> str:
    """CTEs ending in ``sg(symbol, date, close, family, lookback, threshold, signal)`` (no exponential means)."""
    ctes, rows = [], []
    for n in lookbacks:
        c, e = family_sql(n, rel)
        ctes.append(c)
        rows += [f"SELECT symbol, date, close, '{f}' AS family, {n} AS lookback, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b FROM u{n}" for f, (a, b) in e.items()]
    th = ", ".join(str(float(t)) for t in thresholds)
    up = lambda c, d, v="1.0": f"CASE WHEN {c} THEN {v} WHEN {d} THEN -({v}) ELSE 0 END"
    vt = "least(greatest(0.04 * th / (greatest(b, 1e-6) * sqrt(252)), 0), 1)"
    rule = f"""CASE WHEN family IN ('TS_MOMENTUM', 'LAGGED_MOMENTUM', 'MOM_SKIP') THEN {up('a > 0', 'a < 0', 'th / 2.5')} WHEN family IN ('MA_CROSSOVER', 'ROC') THEN {up('a > th / 100', 'a < -th / 100')}
 WHEN family = 'DONCHIAN_BREAKOUT' THEN {up('close > a * (1 + th / 1000)', 'close < b * (1 - th / 1000)')} WHEN family = 'BOLLINGER_REVERT' THEN {up('close < a - th * b', 'close > a + th * b')} WHEN family IN ('BOLLINGER_BREAKOUT', 'KELTNER_BREAKOUT') THEN {up('close > a + th * b', 'close < a - th * b')}
 WHEN family = 'RSI_MEANREVERT' THEN {up('a < 50 - th', 'a > 50 + th')} WHEN family = 'VOLTGT_MOMENTUM' THEN CASE WHEN b IS NULL THEN 0 ELSE {up('a > 0', 'a < 0', vt)} END WHEN family = 'ZSCORE_MEANREVERT' THEN {up('a < -th', 'a > th')} WHEN family = 'AROON' THEN {up('a > th * 20', 'a < -th * 20')}
 WHEN family = 'STOCHASTIC' THEN {up('a < 50 - th * 10', 'a > 50 + th * 10')} WHEN family = 'CCI' THEN {up('a > th * 50', 'a < -th * 50')} WHEN family = 'VOLMANAGED_MOMENTUM' THEN coalesce(CASE WHEN b > 0 THEN sign(a) * least(greatest(0.01 / b, 0), 2) * th / 2.5 END, 0)
 WHEN family = 'ATR_TRAILING_TREND' THEN {up('b > 0 AND a > th * b', 'b > 0 AND a < -th * b')} WHEN family = 'ROLLING_SHARPE_MOM' THEN {up('a > th / 5', 'a < -th / 5')} ELSE CASE WHEN a IS NOT NULL THEN least(greatest(-a * th / 2.5, -1), 1) END END"""
    return f"""{', '.join(ctes)}, ind AS ({' UNION ALL '.join(rows)}), sg AS (SELECT symbol, date, close, family, lookback, th AS threshold, coalesce({rule}, 0) AS signal FROM ind, (SELECT unnest([{th}]::DOUBLE[]) AS th))"""
