"""Join operators: alignment, as-of, tolerant time joins, point-in-time attributes, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import align_to_bar, by, div, round_to_hour, so_far
from quantloom.operators.quantiles import exact_quantiles
from quantloom.sources.market import keep_last


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, key: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Attach the newest ``right.value`` with ``right.on <= left.on`` (``<`` when strict) per key.

    One union and one ordered fill instead of a range join.  Meant for calendar-bounded keys (dates);
    for event tables add a time bucket to the key or use the exact-minute join.
    """
    r = right.select(*key, F.col(on), F.col(value).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    l_cols = [c for c in left.columns if c not in (*key, on)]
    lft = left.select(*key, on, F.struct(*l_cols).alias("_payload")).withColumn("_side", F.lit(0 if strict else 1))
    both = lft.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_is_left", F.lit(True)).unionByName(
        r.withColumn("_payload", F.lit(None).cast(lft.schema["_payload"].dataType)).withColumn("_is_left", F.lit(False)))
    w = (W.partitionBy(*key) if key else W.partitionBy(F.lit(0))).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_is_left")
    return filled.select(*key, on, "_payload.*", value)


def point_in_time_members(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """``in_index`` per (symbol, date); absent means not a member."""
    m = membership.select("symbol", "date", "in_index")
    return panel.join(m, ["symbol", "date"], "left").withColumn("in_index", F.coalesce("in_index", F.lit(False)))


def rename_tickers(df: DataFrame, mapping: list[tuple[object, object, str]]) -> DataFrame:
    """Effective-dated renames applied in list order, so chains compose."""
    c = F.col("symbol")
    for old, new, effective in mapping:
        c = F.when((c == F.lit(old)) & (F.col("date") >= F.lit(effective).cast("date")), F.lit(new)).otherwise(c)
    return df.withColumn("symbol", c)


def aligned_universe(bars: DataFrame, group: Column, name: str = "universe") -> DataFrame:
    """Equal-weight daily return of each universe over dates on which every member trades, and its level from 100."""
    d = bars.withColumn(name, group)
    members = d.groupBy(name).agg(F.countDistinct("symbol").alias("_members"))
    full = d.groupBy(name, "date").agg(F.count(F.lit(1)).alias("_n")).join(members, name).filter("_n = _members").select(name, "date")
    a = d.join(full, [name, "date"]).withColumn("ret", div("close", F.lag("close").over(by())) - 1.0)
    daily = a.groupBy(name, "date").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("n"))
    daily = daily.withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    return daily.withColumn("level", 100.0 * F.product(1.0 + F.col("ret")).over(so_far([name])))


def with_macro(instruments: DataFrame, macro: DataFrame, columns: Sequence[str], key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Left-join a date table and carry its last known values forward."""
    d = instruments.join(F.broadcast(macro.select("date", *columns)), "date", "left")
    return d.withColumns({c: F.last(c, ignorenulls=True).over(so_far(key)) for c in columns})


def date_panel(long: DataFrame, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """Full-outer date panel of a known, small list of series."""
    return long.groupBy("date").pivot(series, list(names)).agg(F.first(value))


def daily_funding(funding: DataFrame) -> DataFrame:
    return funding.groupBy("symbol", F.to_date("funding_time").alias("date")).agg(F.sum("funding_rate").alias("funding"), F.count(F.lit(1)).alias("n_settlements"))


def carry_panel(funding: DataFrame, spot: DataFrame, perp: DataFrame) -> DataFrame:
    """Spot, perpetual and daily funding joined on (symbol, date), with the basis."""
    s = spot.select("symbol", "date", F.col("close").alias("spot"), F.col("low").alias("spot_low"))
    p = perp.select("symbol", "date", F.col("close").alias("perp"), F.col("high").alias("perp_high"))
    return s.join(p, ["symbol", "date"]).join(daily_funding(funding), ["symbol", "date"]).withColumn("basis", div("perp", "spot") - 1.0)


def carry_panel_hourly(funding: DataFrame, spot: DataFrame, perp: DataFrame) -> DataFrame:
    """Funding joined to 8-hour bars after rounding its time to the hour (exact times lose the late stamps)."""
    f = funding.select("symbol", round_to_hour("funding_time").alias("ts"), "funding_rate")
    s = spot.select("symbol", "ts", F.col("close").alias("spot"))
    p = perp.select("symbol", "ts", F.col("close").alias("perp"))
    return f.join(s, ["symbol", "ts"]).join(p, ["symbol", "ts"])


def forward_returns(requests: DataFrame, bars: DataFrame, mode: str = "ceil", bar_minutes: int = 1) -> DataFrame:
    """Return from the fill's minute bar to the bar at the horizon; a missing or non-positive bar gives null and direction 0.

    ``requests``: symbol, fill_ts, horizon_minutes.  ``bars``: symbol, ts, close.  Two equi joins.
    """
    r = requests.withColumn("_entry", F.date_trunc("minute", "fill_ts")).withColumn("_exit", align_to_bar("fill_ts", F.col("horizon_minutes"), bar_minutes, mode))
    e = bars.select("symbol", F.col("ts").alias("_entry"), F.col("close").alias("entry_close"))
    x = bars.select("symbol", F.col("ts").alias("_exit"), F.col("close").alias("exit_close"))
    d = r.join(e, ["symbol", "_entry"], "left").join(x, ["symbol", "_exit"], "left")
    ret = F.when((F.col("entry_close") > 0) & (F.col("exit_close") > 0), F.col("exit_close") / F.col("entry_close") - 1.0)
    return d.withColumn("realized_return", ret).withColumn("realized_direction", F.coalesce(F.signum("realized_return"), F.lit(0.0)).cast("int")).drop("_entry", "_exit")


def assemble_signals(predictions: DataFrame, verdicts: DataFrame, fills: DataFrame) -> DataFrame:
    """Predictions with their verdicts and fills by signal id; a missing verdict is insufficient evidence."""
    d = predictions.join(verdicts, "signal_id", "full").join(fills, "signal_id", "left")
    return d.withColumn("decision", F.coalesce("decision", F.lit("insufficient_evidence"))).withColumn("filled", F.col("fill_price").isNotNull())


def registry_overlap(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Mapped and unmapped keys of ``left`` in ``right`` by key or by normalised name, with the 90% gate."""
    norm = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), r"\b(inc|corp|co|ltd|plc)\b| +", " "))
    lk = left.select(F.col(key).alias("k"), norm(F.col(name)).alias("n")).distinct()
    rk, rn = right.select(F.col(key).alias("k")).distinct().withColumn("_k", F.lit(True)), right.select(norm(F.col(name)).alias("n")).distinct().withColumn("_n", F.lit(True))
    d = lk.join(rk, "k", "left").join(rn, "n", "left").withColumn("via", F.when(F.col("_k"), "id").when(F.col("_n"), "name").otherwise("unmapped"))
    out = d.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("via") == "id").alias("by_id"), F.count_if(F.col("via") == "name").alias("by_name"),
                F.count_if(F.col("via") == "unmapped").alias("unmapped"))
    return out.withColumn("mapped_share", div(F.col("by_id") + F.col("by_name"), "n_keys")).withColumn("gate_pass", F.col("mapped_share") >= 0.9)


# Exit reasons by class.
DELISTED = ("bankruptcy", "regulatory_delisting", "going_to_zero", "delisted")
MERGED = ("acquired", "merger", "going_private", "buyout")
RENAMED = ("ticker_change",)


def classify_exit(reason: Column, known: Column) -> Column:
    r = F.lower(reason)
    return (F.when(r.isin(*RENAMED), "ticker_changed")
            .when(r.isin(*DELISTED), F.when(known, "delisted_captured").otherwise("delisted_missing"))
            .when(r.isin(*MERGED), F.when(known, "merger_captured").otherwise("merger_missing")).otherwise("unknown_exit"))


def audit_exits(panel: DataFrame, exits: DataFrame) -> DataFrame:
    """Symbols whose last date lies before the panel's last date, classified through the exits feed."""
    last = panel.groupBy("symbol").agg(F.max("date").alias("exit_date"))
    top = last.agg(F.max("exit_date").alias("_top"))
    gone = last.crossJoin(F.broadcast(top)).filter("exit_date < _top").drop("_top")  # one-row side
    feed = keep_last(exits.select("symbol", "exit_reason", "terminal_return_known", "terminal_return_value", F.lit(True).alias("_in")), ["symbol"], ["exit_reason"], first=True)
    d = gone.join(feed, "symbol", "left")
    return d.select("symbol", "exit_date", F.coalesce("exit_reason", F.lit("unknown")).alias("exit_reason"),
                    F.coalesce("terminal_return_known", F.lit(False)).alias("terminal_return_captured"), "terminal_return_value",
                    F.when(F.col("_in"), "exits_feed").otherwise("panel_inferred").alias("classification_source"),
                    F.when(F.col("_in"), classify_exit(F.col("exit_reason"), F.col("terminal_return_known"))).otherwise("unknown_exit").alias("classification"))


def exit_counters(audit: DataFrame) -> DataFrame:
    return audit.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def capture_ratio(audit: DataFrame) -> DataFrame:
    c = F.col("classification")
    caught, total = F.count_if(c.endswith("_captured") | (c == "ticker_changed")), F.count(F.lit(1))
    return audit.agg(caught.alias("captured"), total.alias("total"), F.count_if(c == "unknown_exit").alias("unknown")).withColumn(
        "capture_ratio", F.when(F.col("total") == 0, 1.0).otherwise(div("captured", "total")))


def point_in_time_label(ratio: DataFrame, source: str) -> DataFrame:
    """Three-tier quality label from membership source, capture ratio and unknown exits."""
    ok = (F.col("capture_ratio") >= 0.95) & (F.col("unknown") == 0)
    if source == "absent_prototype_only":
        label = F.lit("survivorship_prototype_only")
    elif source == "wikipedia_fallback":
        label = F.lit("partial_pit_universe")
    else:
        label = F.when(ok, "pit_safe").otherwise("partial_pit_universe")
    return ratio.withColumn("quality_label", label)


def first_dimension(facts: DataFrame, dim: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Attach the first dimension row per key; unmatched facts keep their own key."""
    d = keep_last(dim.select(key, value, *[o for o in order if o != value]), [key], list(order), first=True).select(key, value)
    return facts.join(d, key, "left").withColumn(value, F.coalesce(F.col(value), F.col(key)))


def gate_by_regime(signals: DataFrame, regime: DataFrame, flag: str, signal: str = "signal") -> DataFrame:
    """Zero the signal on dates whose regime is not favourable (or unknown)."""
    d = signals.join(F.broadcast(regime.select("date", flag)), "date", "left")
    return d.withColumn(signal, F.when(F.coalesce(F.col(flag), F.lit(False)), F.col(signal)).otherwise(0.0)).drop(flag)


def keep_by_probability(signals: DataFrame, probabilities: DataFrame, threshold: float, key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    d = signals.join(probabilities.select(*key, "probability"), list(key), "left")
    return d.withColumn("signal", F.when(F.coalesce("probability", F.lit(0.0)) >= threshold, F.col("signal")).otherwise(0.0))


def crosscheck_close(ticks: DataFrame, daily: DataFrame) -> DataFrame:
    """Last tick of the day against the daily close: mean, 99th percentile and maximum relative difference."""
    mine = ticks.groupBy("symbol", F.to_date("event_time").alias("date")).agg(F.max_by("price", F.struct("event_time", "trade_id")).alias("mine"))
    d = mine.join(daily.select("symbol", "date", F.col("close").alias("theirs")), ["symbol", "date"]).withColumn("rel", F.abs(div("mine", "theirs") - 1.0))
    q = exact_quantiles(d, "rel", [0.99]).select(F.col("q")[0].alias("p99_diff"))
    return d.agg(F.count(F.lit(1)).alias("n_days"), F.avg("rel").alias("mean_diff"), F.max("rel").alias("max_diff")).crossJoin(q)  # one-row tables


def cash_yield(dates: DataFrame, rates: DataFrame, assumption: str) -> DataFrame:
    """Daily cash yield: zero, T-bill/365, or T-bill less 25 bp; carried forward along the dates, 0 before the first rate."""
    d = dates.join(F.broadcast(rates.select("date", "annual_rate")), "date", "left")
    carried = F.coalesce(F.last("annual_rate", ignorenulls=True).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    value = {"zero": F.lit(0.0), "tbill": carried / 365.0, "tbill_minus_25bps": (carried - 0.0025) / 365.0}[assumption]
    return d.withColumn("cash_yield", value).drop("annual_rate")


def reattach_keys(scores: DataFrame, source: DataFrame, key: Sequence[str], columns: Sequence[str], tol: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """Join scores to their source rows by key and report the largest difference of the shared columns."""
    s = source.select(*key, *[F.col(c).alias(f"_src_{c}") for c in columns])
    d = scores.join(s, list(key))
    check = d.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c) - F.col(f"_src_{c}"))).alias(f"max_diff_{c}") for c in columns])
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.col(f"max_diff_{c}") <= tol)
    return d, check.withColumn("aligned", ok)


def adverse_basis(panel: DataFrame) -> DataFrame:
    """Carry marks: spot return less perpetual return and the adverse intrabar change of the basis."""
    w = by()
    d = panel.withColumns({"spot_ret": F.coalesce(div("spot", F.lag("spot").over(w)) - 1.0, F.lit(0.0)), "perp_ret": F.coalesce(div("perp", F.lag("perp").over(w)) - 1.0, F.lit(0.0))})
    return d.withColumns({"price_pnl": F.col("spot_ret") - F.col("perp_ret"),
                          "adverse_dbasis": div("perp_high", "spot_low") - 1.0 - F.coalesce(F.lag("basis").over(w), F.col("basis"))})
