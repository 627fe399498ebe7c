"""Data-quality checks as aggregates and small joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.operators.blocks import BLOCK_ROWS, blocked
from quantloom.operators.quantiles import exact_quantiles


def timestamp_unit(df: DataFrame, raw: str) -> DataFrame:
    """Milliseconds or microseconds, decided by the largest raw value."""
    return df.agg(F.when(F.max(raw) > 1_000_000_000_000_000, "us").otherwise("ms").alias("unit"))


def tick_timestamps(df: DataFrame, order: str = "trade_id", key: str = "symbol", time: str = "event_time", identity: Sequence[str] = ("trade_id", "event_time", "price", "size"),
                    block_rows: int = BLOCK_ROWS, order_bucket: int = 1 << 16) -> DataFrame:
    """Per symbol: smallest positive gap, share in order, share of exact duplicates and longest gap.

    Rows are compared with their predecessor in arrival order (an integer id), block by block.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    d = df.withColumn("_us", us).withColumn("_arrival", F.timestamp_seconds(F.col(order)))
    d = blocked(d, lambda x, over: x.withColumn("_gap", F.col("_us") - F.lag("_us").over(over())), back=1, time="_arrival", ties=(time,), key=key, block_rows=block_rows, bucket_seconds=order_bucket)
    g = F.col("_gap")
    t = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(g > 0, g)).alias("min_gap_us"), F.max(g).alias("max_gap_us"), (div(F.count_if(g >= 0), F.count(g)) * 100).alias("monotone_pct"))
    dup = df.groupBy(key, *identity).agg(F.count(F.lit(1)).alias("_c")).groupBy(key).agg(F.count_if(F.col("_c") > 1).alias("_dup"))
    return t.join(dup, key).withColumn("duplicate_pct", div("_dup", "n") * 100).drop("_dup")


def trade_quality(df: DataFrame, key: str = "symbol", time: str = "event_time", sigma: float = 5.0) -> DataFrame:
    """Aggressor coverage, zero prices and sizes, and prices beyond ``sigma`` of their minute."""
    d = df.withColumn("_m", F.date_trunc("minute", time))
    stats = d.groupBy(key, "_m").agg(F.avg("price").alias("_mu"), F.stddev_samp("price").alias("_sd"))
    d = d.join(stats, [key, "_m"])
    pct = lambda c: F.avg(c.cast("double")) * 100
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), pct(F.col("aggressor_sign").isNotNull()).alias("aggressor_pct"), pct(F.col("size") <= 0).alias("zero_size_pct"),
                              pct(F.col("price") <= 0).alias("zero_price_pct"), pct(F.coalesce((F.col("_sd") > 0) & (F.abs(F.col("price") - F.col("_mu")) > sigma * F.col("_sd")), F.lit(False))).alias("outlier_pct"))


def book_snapshots(df: DataFrame, min_levels: int = 10) -> DataFrame:
    """Depth and crossing checks per snapshot, then the decision over all of them per symbol."""
    deep = (F.size("bids") >= min_levels) & (F.size("asks") >= min_levels)
    uncrossed = F.coalesce(F.get(F.get("bids", 0), 0) < F.get(F.get("asks", 0), 0), F.lit(False))
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(deep.cast("double")).alias("deep_share"), F.avg(uncrossed.cast("double")).alias("uncrossed_share"),
                                   F.bool_and(deep).alias("all_deep"), F.bool_and(uncrossed).alias("all_uncrossed"))
    return out.withColumn("decision", F.when(F.col("all_deep") & F.col("all_uncrossed"), "usable").when(F.col("all_uncrossed"), "l1_only").otherwise("reject"))


def probe_names(probe: DataFrame, reference: DataFrame, actions: DataFrame, prices: DataFrame, key: str = "symbol") -> DataFrame:
    """For a list of names: present in the reference, a delisting action on file, last price known."""
    acts = actions.groupBy(key).agg(F.max(F.col("action").rlike("(?i)delist|bankrupt|acqui|merger").cast("int")).alias("_a"))
    last = prices.groupBy(key).agg(F.max("date").alias("last_price_date"))
    d = probe.join(reference.select(key, F.lit(True).alias("_r")).distinct(), key, "left").join(acts, key, "left").join(last, key, "left")
    return d.select(key, F.coalesce("_r", F.lit(False)).alias("in_reference"), (F.coalesce("_a", F.lit(0)) == 1).alias("has_exit_action"), "last_price_date",
                    (F.col("last_price_date").isNotNull() & (F.coalesce("_a", F.lit(0)) == 1)).alias("final_return_computable"))


def panel_audit(df: DataFrame, value: str, key: str = "symbol", date: str = "date", lo: float = 0.0, hi: float = 1e9, quantiles: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """One wide aggregate: rows, keys, nulls, non-positive, out-of-range, quantiles; duplicate keys by a combinable count."""
    v = F.col(value)
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(v.isNull()).alias("n_null"), F.count_if(v <= 0).alias("n_nonpositive"),
                  F.count_if((v < lo) | (v > hi)).alias("n_out_of_range"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    dup = df.groupBy(key, date).agg(F.count(F.lit(1)).alias("_c")).agg(F.count_if(F.col("_c") > 1).alias("n_duplicate_keys"))
    return wide.crossJoin(dup).crossJoin(exact_quantiles(df, value, quantiles, name="_q").drop("n")).select("*", *[F.col("_q")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(quantiles)]).drop("_q")  # one-row tables


def per_year_coverage(df: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    return df.groupBy(F.year(date).alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.countDistinct(date).alias("n_dates"))


def date_gaps(df: DataFrame, key: str = "symbol", date: str = "date") -> DataFrame:
    """Missing calendar days between first and last date, per key."""
    return df.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("n_dates")).withColumn(
        "gap_days", F.datediff("last_date", "first_date") + 1 - F.col("n_dates"))


def common_window(coverage: DataFrame) -> DataFrame:
    """Latest start and earliest end over all series."""
    return coverage.agg(F.max("first_date").alias("window_start"), F.min("last_date").alias("window_end"), F.count(F.lit(1)).alias("n_series"))


def storage_projection(df: DataFrame, bytes_per_row: float, date: str = "date") -> DataFrame:
    per = df.groupBy(date).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.avg("_n").alias("rows_per_day"), (F.avg("_n") * bytes_per_row * 365 / 1e9).alias("gb_per_year"))


def event_calendar(events: DataFrame, trading: DataFrame, per_year: int = 8) -> DataFrame:
    """Unique, ordered, expected count per year, and every event on a trading day (calendar-sized tables)."""
    d = events.select("date").withColumn("_prev", F.lag("date").over(W.orderBy("date")))
    base = d.agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("_prev") == F.col("date")).alias("n_duplicates"))
    years = events.groupBy(F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") != per_year).alias("n_years_off"))
    off = events.select("date").distinct().join(trading.select("date").distinct(), "date", "left_anti").agg(F.count(F.lit(1)).alias("n_off_calendar"))
    return base.crossJoin(years).crossJoin(off)  # one-row tables


# ---------------------------------------------------------------- guards

def leakage_columns(df: DataFrame, target: str, features: Sequence[str], limit: float = 0.999) -> DataFrame:
    """Features without nulls whose |correlation| to the target reaches ``limit``: one aggregate, one row per feature."""
    aggs = [F.corr(c, target).alias(f"c_{c}") for c in features] + [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in features]
    row = df.agg(*aggs)
    d = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c_{c}").alias("corr"), F.col(f"n_{c}").alias("nulls")) for c in features])).alias("s")).select("s.*")
    return d.withColumn("leaks", F.coalesce((F.col("nulls") == 0) & (F.abs("corr") >= limit), F.lit(False)))


def contract_violations(df: DataFrame, as_of: str = "feature_as_of_date", execution: str = "execution_date", key: Sequence[str] = ("execution_date", "symbol")) -> DataFrame:
    """Rows whose features are not older than their execution, and duplicate keys, as one row of counts."""
    late = df.agg(F.count_if(~(F.col(as_of) < F.col(execution)) | F.col(as_of).isNull()).alias("n_late"))
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).agg(F.count_if(F.col("_c") > 1).alias("n_duplicate_keys"))
    return late.crossJoin(dup)  # one-row tables


LABEL_TOKENS = ("future", "forward", "label", "target", "responder", "direction_", "mid_direction_", "pred_")
IDENTIFIERS = ("date", "symbol", "timestamp", "event_time", "date_id", "time_id", "symbol_id", "weight", "row_id")


def feature_columns(df: DataFrame, prefix: str = "", exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are neither identifiers nor label-like."""
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [n for n, t in df.dtypes if t in numeric and n.startswith(prefix) and n not in IDENTIFIERS and n not in exclude and not any(k in n for k in LABEL_TOKENS)]


def forbidden_features(names: Sequence[str]) -> list[str]:
    return [n for n in names if any(k in n.lower() for k in LABEL_TOKENS)]


def quality_banner(df: DataFrame, tier: Column) -> DataFrame:
    """Banner and bridge flags from the data tier."""
    safe = tier == "pit_safe"
    return df.withColumns({"research_grade": safe, "banner": F.when(safe, "point-in-time data").when(tier == "partial_pit_universe", "partial point-in-time universe").otherwise("prototype: survivorship bias")})
