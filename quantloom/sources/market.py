"""Normalisers from landed raw tables to the canonical panels and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.functions.columns import finite, require_columns

OHLCV = ("open", "high", "low", "close", "volume")


def to_date_lenient(df: DataFrame, name: str) -> Column:
    """Date from a date, a timestamp or the first ten characters of a text; unparsable gives null."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.expr(f"try_cast(substr(`{name}`, 1, 10) AS DATE)")
    return F.to_date(name)


def normalise_ohlcv(df: DataFrame, dataset_id: str, date_column: str, symbol_column: str, names: dict[str, str] | None = None) -> DataFrame:
    """Canonical daily bars: lenient casts, complete rows only, positive open and close."""
    names = names or {c: c for c in OHLCV}
    require_columns(df, [date_column, symbol_column, *names.values()])
    d = df.select(F.lit(dataset_id).alias("dataset_id"), to_date_lenient(df, date_column).alias("date"),
                  F.col(symbol_column).cast("string").alias("symbol"),
                  *[F.expr(f"try_cast(`{names[c]}` AS DOUBLE)").alias(c) for c in OHLCV])
    return d.dropna(subset=["date", "symbol", *OHLCV]).filter("close > 0 AND open > 0")


def filter_tradable(df: DataFrame, min_close: float, min_dollar_volume: float, max_abs_forward: float, forward: str = "future_return_1") -> DataFrame:
    return df.filter((F.col("close") >= min_close) & (F.col("dollar_volume") >= min_dollar_volume) & (F.abs(forward) <= max_abs_forward))


def last_dates(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the newest ``n`` distinct dates."""
    keep = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    return df.join(F.broadcast(keep), date, "left_semi")


# Defaults of this package: column aliases accepted for each canonical field, best first.
FIELD_ALIASES = {
    "timestamp": ("timestamp", "open_time", "datetime", "date", "time", "event_time", "ts"),
    "open": ("open", "open_price"), "high": ("high", "high_price"), "low": ("low", "low_price"),
    "close": ("close", "close_price", "adj_close", "price"), "volume": ("volume", "vol", "quantity"),
    "symbol": ("symbol", "ticker", "asset", "instrument"),
}


def resolve_fields(columns: list[str]) -> dict[str, str]:
    """Canonical field to actual column name, case-insensitive, first alias wins."""
    lower = {c.lower(): c for c in columns}
    found = {}
    for field, aliases in FIELD_ALIASES.items():
        for a in aliases:
            if a in lower:
                found[field] = lower[a]
                break
    return found


def canonical_market(df: DataFrame, dataset_id: str) -> DataFrame:
    """Canonical bars from a frame with arbitrary column names; the symbol defaults to the dataset id.

    Without a time column rows keep their order of reading: ``_metadata`` block position for files.
    """
    f = resolve_fields(df.columns)
    require_columns(df, [f[k] for k in ("close",) if k in f] or ["close"])
    time = F.col(f["timestamp"]) if "timestamp" in f else F.monotonically_increasing_id()
    symbol = F.col(f["symbol"]).cast("string") if "symbol" in f else F.lit(dataset_id)
    value = lambda k: F.expr(f"try_cast(`{f[k]}` AS DOUBLE)") if k in f else F.lit(None).cast("double")
    return df.select(F.lit(dataset_id).alias("dataset_id"), symbol.alias("symbol"), time.alias("timestamp"), *[value(k).alias(k) for k in OHLCV])


def tail_groups_by_row_budget(df: DataFrame, group: str, max_rows: int) -> DataFrame:
    """Newest whole groups whose running row count fits the budget, plus one more group.

    The running count is over one row per group (a date), so the single ordered window is
    calendar-bounded; the rows themselves only meet a semi join.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    w = W.orderBy(F.col(group).desc()).rowsBetween(W.unboundedPreceding, -1)
    keep = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") <= max_rows).select(group)
    return df.join(keep, group, "left_semi")


def union_schemas(frames: list[DataFrame]) -> DataFrame:
    """Union by name, missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, key: list[str], order: list[str], first: bool = False) -> DataFrame:
    """Deterministic distinct on a key: the last (or first) row by ``order``, by a combinable aggregate.

    ``max_by`` over the row struct merges on the map side, so many copies of one key cost no hot task.
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by if first else F.max_by
    d = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return d.select(*key, "_row.*").select(*df.columns)


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Append and keep the incoming row where a key is present in both."""
    both = existing.withColumn("_arrival", F.lit(0)).unionByName(incoming.withColumn("_arrival", F.lit(1)), allowMissingColumns=True)
    order = ["_arrival"] + [c for c in existing.columns if c not in key]
    return keep_last(both, key, order).drop("_arrival")


def last_months(df: DataFrame, time: str, months: float, exact_days: bool = False) -> DataFrame:
    """Keep the last months before the newest timestamp, by calendar months or 30.4375-day months."""
    top = df.agg(F.max(time).alias("_top"))
    cut = F.expr(f"_top - make_interval(0, {int(months)})") if not exact_days else \
        F.timestamp_micros(F.unix_micros(F.col("_top").cast("timestamp")) - int(months * 30.4375 * 86_400_000_000))
    return df.crossJoin(F.broadcast(top)).filter(F.col(time) >= cut.cast(df.schema[time].dataType)).drop("_top")  # one-row side


def epoch_to_timestamp(x: str | Column) -> Column:
    """Milliseconds, or microseconds when the number is too large for milliseconds."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c > 10_000_000_000_000, F.timestamp_micros(c)).otherwise(F.timestamp_millis(c))


def normalise_klines(raw: DataFrame, symbol: str | Column) -> DataFrame:
    require_columns(raw, ["open_time", "open", "high", "low", "close"])
    d = raw.select((F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), epoch_to_timestamp("open_time").alias("ts"),
                   *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    return keep_last(d, ["symbol", "ts"], ["close", "open", "high", "low"])


def normalise_funding(raw: DataFrame, symbol: str | Column) -> DataFrame:
    require_columns(raw, ["calc_time", "funding_interval_hours", "last_funding_rate"])
    d = raw.select((F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.timestamp_millis("calc_time").alias("funding_time"),
                   F.col("last_funding_rate").cast("double").alias("funding_rate"), F.col("funding_interval_hours").cast("long").alias("interval_hours"))
    return keep_last(d, ["symbol", "funding_time"], ["funding_rate", "interval_hours"])


def funding_coverage(funding: DataFrame) -> DataFrame:
    """Rows, range and annualised mean (three settlements a day)."""
    return funding.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("funding_time").alias("first_time"), F.max("funding_time").alias("last_time"),
                                         (F.avg("funding_rate") * 3 * 365).alias("annualized_funding"))


def normalise_quotes(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """L1 quotes; crossed, locked and non-positive books are dropped."""
    require_columns(raw, ["transaction_time", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty"])
    d = raw.select((F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.timestamp_millis("transaction_time").alias("event_time"),
                   F.col("best_bid_price").cast("double").alias("best_bid"), F.col("best_ask_price").cast("double").alias("best_ask"),
                   F.col("best_bid_qty").cast("double").alias("best_bid_size"), F.col("best_ask_qty").cast("double").alias("best_ask_size"))
    return d.filter("best_bid > 0 AND best_ask > 0 AND best_bid < best_ask")


def normalise_trades(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Aggregated trades with aggressor sign and unique, increasing event times.

    The k-th trade of a symbol in one millisecond is moved by k microseconds; the numbering window is
    per (symbol, millisecond), a small group.
    """
    require_columns(raw, ["agg_trade_id", "price", "quantity", "transact_time", "is_buyer_maker"])
    maker = F.lower(F.col("is_buyer_maker").cast("string")).isin("true", "1")
    d = raw.select((F.lit(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), "agg_trade_id", F.col("price").cast("double").alias("price"),
                   F.col("quantity").cast("double").alias("size"), F.when(maker, -1.0).otherwise(1.0).alias("aggressor_sign"),
                   F.col("transact_time").cast("long").alias("_ms")).filter("price > 0 AND size > 0")
    k = F.row_number().over(W.partitionBy("symbol", "_ms").orderBy("agg_trade_id")) - 1
    return d.withColumn("event_time", F.timestamp_micros(F.col("_ms") * 1000 + k)).select("symbol", "event_time", "price", "size", "aggressor_sign")


# Wire layouts of the market events, one schema per kind.
EVENT_SCHEMAS = {
    "agg_trade": "s STRING, a BIGINT, p STRING, q STRING, T BIGINT, m BOOLEAN",
    "book_ticker": "s STRING, u BIGINT, b STRING, B STRING, a STRING, A STRING, T BIGINT",
    "depth_update": "s STRING, E BIGINT, u BIGINT, b ARRAY<ARRAY<STRING>>, a ARRAY<ARRAY<STRING>>",
}


def levels(x: str | Column) -> Column:
    """``[[price, qty], …]`` of strings to arrays of doubles; unparsable or infinite levels are dropped."""
    c = F.col(x) if isinstance(x, str) else x
    arr = F.transform(F.filter(c, lambda v: F.size(v) >= 2), lambda v: F.transform(F.slice(v, 1, 2), lambda s: s.try_cast("double")))
    return F.filter(arr, lambda v: v[0].isNotNull() & v[1].isNotNull() & ~F.isnan(v[0]) & ~F.isnan(v[1])
                    & (F.abs(v[0]) < float("inf")) & (F.abs(v[1]) < float("inf")))


def parse_agg_trade(df: DataFrame, value: str = "value") -> DataFrame:
    j = F.from_json(F.col(value), EVENT_SCHEMAS["agg_trade"])
    d = df.withColumn("_j", j)
    return d.select(F.col("_j.s").alias("symbol"), F.timestamp_millis("_j.T").alias("event_time"), F.col("_j.a").alias("trade_id"),
                    F.col("_j.p").cast("double").alias("price"), F.col("_j.q").cast("double").alias("size"),
                    F.when(F.col("_j.m"), -1.0).otherwise(1.0).alias("aggressor_sign"))


def parse_book_ticker(df: DataFrame, value: str = "value") -> DataFrame:
    d = df.withColumn("_j", F.from_json(F.col(value), EVENT_SCHEMAS["book_ticker"]))
    return d.select(F.col("_j.s").alias("symbol"), F.timestamp_millis("_j.T").alias("event_time"), F.col("_j.u").alias("update_id"),
                    *[F.col(f"_j.{k}").cast("double").alias(n) for k, n in (("b", "best_bid"), ("B", "best_bid_size"), ("a", "best_ask"), ("A", "best_ask_size"))])


def parse_depth_update(df: DataFrame, value: str = "value") -> DataFrame:
    d = df.withColumn("_j", F.from_json(F.col(value), EVENT_SCHEMAS["depth_update"], {"caseSensitive": "true"}))
    return d.select(F.col("_j.s").alias("symbol"), F.timestamp_millis("_j.E").alias("event_time"), F.col("_j.u").alias("update_id"),
                    levels("_j.b").alias("bids"), levels("_j.a").alias("asks"))


TICK_SCHEMA = ("venue STRING, symbol STRING, side STRING, timestamp_utc TIMESTAMP, received_utc TIMESTAMP, price DOUBLE, size DOUBLE, sequence BIGINT")


def valid_ticks(df: DataFrame) -> DataFrame:
    """The record constraints of a tick: positive price, non-negative size, known side."""
    return df.filter((F.col("price") > 0) & (F.col("size") >= 0) & F.col("side").isin("buy", "sell", "unknown"))


def parse_venue_messages(df: DataFrame, value: str = "value", venue: str = "venue") -> DataFrame:
    """Trade and match messages of two venues to the common tick row; other message kinds are dropped."""
    d = df.withColumn("_j", F.from_json(F.col(value), "e STRING, s STRING, p STRING, q STRING, T BIGINT, a BIGINT, m BOOLEAN, type STRING, "
                                                       "product_id STRING, price STRING, size STRING, side STRING, time STRING, sequence BIGINT"))
    j = lambda k: F.col(f"_j.{k}")
    trade, match = j("e") == "aggTrade", j("type").isin("match", "last_match")
    d = d.filter(trade | match).select(
        F.col(venue).alias("venue"), F.when(trade, j("s")).otherwise(j("product_id")).alias("symbol"),
        F.when(trade, F.when(j("m"), "sell").otherwise("buy")).otherwise(j("side")).alias("side"),
        F.when(trade, F.timestamp_millis(j("T"))).otherwise(F.try_to_timestamp(j("time"))).alias("timestamp_utc"),
        F.when(trade, j("p")).otherwise(j("price")).cast("double").alias("price"), F.when(trade, j("q")).otherwise(j("size")).cast("double").alias("size"),
        F.when(trade, j("a")).otherwise(j("sequence")).alias("sequence"))
    return valid_ticks(d)


def parse_bar_list(df: DataFrame, value: str = "value") -> DataFrame:
    """A response holding a list of bars to one row per bar (interval 1 to 86400 seconds, positive prices)."""
    d = df.withColumn("_j", F.from_json(F.col(value), "symbol STRING, interval INT, bars ARRAY<STRUCT<t:BIGINT,o:DOUBLE,h:DOUBLE,l:DOUBLE,c:DOUBLE,v:DOUBLE,n:BIGINT>>"))
    d = d.select(F.col("_j.symbol").alias("symbol"), F.col("_j.interval").alias("interval_seconds"), F.explode("_j.bars").alias("b"))
    d = d.select("symbol", "interval_seconds", F.timestamp_millis("b.t").alias("timestamp_utc"), F.col("b.o").alias("open"), F.col("b.h").alias("high"),
                 F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.n").alias("n_trades"))
    return d.filter("interval_seconds BETWEEN 1 AND 86400 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0")


def daily_panel(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Canonical daily layout; the adjusted close is preferred when the landed table has one."""
    close = F.coalesce(F.col(mapping["adj_close"]), F.col(mapping["close"])) if "adj_close" in mapping else F.col(mapping["close"])
    return raw.select(F.to_date(mapping["date"]).alias("date"), F.col(mapping["symbol"]).alias("symbol"),
                      *[F.col(mapping[c]).cast("double").alias(c) for c in ("open", "high", "low")], close.cast("double").alias("close"),
                      F.col(mapping["volume"]).cast("double").alias("volume")).filter("close IS NOT NULL")


def first_rows_per_file(df: DataFrame, n: int, target: str | None = None) -> DataFrame:
    """First ``n`` rows of every parquet file by its row index (no shuffle), tagged with the file, finite targets only."""
    d = df.filter(F.col("_metadata.row_index") < n).withColumn("source_file", F.col("_metadata.file_name"))
    return d if target is None else d.filter(finite(target))


def symbol_from_path(path: str | Column) -> Column:
    """Symbol of a feature file: the parent folder or a file-name token that ends in USDT, else the folder."""
    p = F.col(path) if isinstance(path, str) else path
    parent, stem = F.element_at(F.split(p, "/"), -2), F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    token = F.get(F.filter(F.split(stem, "_"), lambda t: F.upper(t).endswith("USDT")), 0)
    return F.upper(F.when(F.upper(parent).endswith("USDT"), parent).otherwise(F.coalesce(token, F.when(parent != "", parent), stem)))
