"""Source normalisation, projection, join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import align_to_bar, by, clip, code_map, div, finite, mean_of, next_weekday, zero_fill
from quantloom.operators import aggregates as ag
from quantloom.operators import joins as jn
from quantloom.operators import ticks as tk
from quantloom.plans.registry import query
from quantloom.plans.sqltext import SOFAR
from quantloom.plans.views import bars, dividends, exits, membership, scored, sectors, table, ticks
from quantloom.sources import market as mk

RET = "ret AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) * 0.01 AS ret FROM bars)"


def small_returns(spark, sf):
    """Daily returns scaled to a realistic size (the bound prices are noisy)."""
    d = bars(spark, sf)
    return d.withColumn("ret", F.coalesce(div("close", F.lag("close").over(by())) - 1.0, F.lit(0.0)) * 0.01)


@query("SRC1 SRC2 SRC3", """WITH @scored, c AS (SELECT date, count(*) AS n FROM scored GROUP BY date),
k AS (SELECT date, coalesce(sum(n) OVER (ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT date, count(*) AS n_rows, sum(w) AS weight FROM scored WHERE date IN (SELECT date FROM k WHERE before <= 1000) GROUP BY date""", "weight", digits=3)
def tail_by_row_budget(spark, sf):
    from quantloom.functions.columns import require_columns
    d = mk.tail_groups_by_row_budget(require_columns(scored(spark, sf), ["date", "y", "w"]), "date", 1000)
    return d.groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("w").alias("weight"))


@query("SRC4 ST1", """SELECT source, count(*) AS n, count(name) AS n_name, count(balance) AS n_balance, count(segment) AS n_segment, sum(balance) AS balance FROM (
  SELECT 'customer' AS source, c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, NULL FROM supplier UNION ALL SELECT 'part', p_partkey, p_name, NULL, NULL FROM part) GROUP BY source""", "balance", digits=2)
def schema_union(spark, sf):
    c, s, p = (table(spark, sf, t) for t in ("customer", "supplier", "part"))
    u = mk.union_schemas([
        c.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        s.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        p.select(F.lit("part").alias("source"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))])
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("n_name"), F.count("balance").alias("n_balance"), F.count("segment").alias("n_segment"), F.sum("balance").alias("balance"))


@query("SRC5 SRC18", """WITH @bars SELECT 'panel' AS dataset_id, CAST(symbol AS VARCHAR) AS symbol, date AS timestamp, close, volume, lead(close, 1) OVER w / close - 1 AS future_return_1,
  CAST(lead(close, 1) OVER w / close - 1 > 0 AS TINYINT) AS direction_up_1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "close volume future_return_1", digits=5)
def canonical_market(spark, sf):
    from quantloom.operators.features import horizon_labels
    raw = bars(spark, sf).select(F.col("symbol").alias("Ticker"), F.col("date").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                                 F.col("close").alias("Close_Price"), F.col("volume").alias("Vol"))
    d = mk.canonical_market(raw, "panel")
    return horizon_labels(d, (1,), time=["timestamp"]).select("dataset_id", "symbol", "timestamp", "close", "volume", "future_return_1", "direction_up_1")


@query("SRC7 AG21 AG22 SRC23", """SELECT 'orders' AS table_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_symbols, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date,
  count(*) AS row_count, CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS manifest_start FROM orders""")
def table_metadata(spark, sf):
    from quantloom.sources.tables import dataset_manifest, table_metadata as meta, validate_schema
    d = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    assert not validate_schema(d, ["o_custkey", "d"])["missing"]
    m = meta(d, "orders", "o_custkey", "d").drop("fingerprint")
    man = dataset_manifest(d, "orders", "o_custkey", "d", "close", "daily").select("row_count", F.col("start").alias("manifest_start"))
    return m.crossJoin(man)  # two one-row tables


@query("SRC9 SRC6", """SELECT symbol, count(*) AS n, avg(best_ask - best_bid) AS spread, max(event_time) AS last_time FROM (
  SELECT user_id AS symbol, make_timestamp(epoch_us(ts) // 1000 * 1000) AS event_time, value * (1 - 0.001) AS best_bid, value * (1 + 0.001 * (event_id % 3 - 0.5)) AS best_ask FROM events)
  WHERE best_bid > 0 AND best_ask > 0 AND best_bid < best_ask GROUP BY symbol""", "spread")
def normalised_quotes(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("transaction_time"), (F.col("value") * (1 - 0.001)).alias("best_bid_price"), F.lit(1.0).alias("best_bid_qty"),
                   (F.col("value") * (1 + 0.001 * (F.col("event_id") % 3 - 0.5))).alias("best_ask_price"), F.lit(1.0).alias("best_ask_qty"))
    d = mk.normalise_quotes(raw, F.col("user_id"))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("best_ask") - F.col("best_bid")).alias("spread"), F.max("event_time").cast("timestamp_ntz").alias("last_time"))


@query("SRC10", """SELECT symbol, make_timestamp(ms * 1000 + row_number() OVER (PARTITION BY symbol, ms ORDER BY id) - 1) AS event_time, price, size, aggressor_sign FROM (
  SELECT user_id AS symbol, epoch_ms(ts) // 3600000 * 3600000 AS ms, event_id AS id, value AS price, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS size,
  CASE WHEN event_type IN ('view', 'error') THEN -1.0 ELSE 1.0 END::DOUBLE AS aggressor_sign FROM events WHERE value > 0)""")
def normalised_trades(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select("user_id", F.col("event_id").alias("agg_trade_id"), F.col("value").alias("price"), (F.from_json("props", "k INT")["k"] + 1).alias("quantity"),
                   (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000) * 3600000).alias("transact_time"),
                   F.when(F.col("event_type").isin("view", "error"), "True").otherwise("False").alias("is_buyer_maker"))
    return mk.normalise_trades(raw, F.col("user_id")).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("SRC11 JN6", """WITH f AS (SELECT user_id AS symbol, epoch_ms(ts) // 28800000 * 28800000 AS ms, max(value) AS r FROM events GROUP BY 1, 2)
SELECT symbol, count(*) AS n_rows, avg(r * 1e-5) * 3 * 365 AS annualized_funding FROM f GROUP BY symbol""", "annualized_funding", digits=5)
def funding_coverage(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select("user_id", (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 28800000) * 28800000).alias("calc_time"), F.lit(8).alias("funding_interval_hours"), (F.col("value") * 1e-5).alias("last_funding_rate"))
    return mk.funding_coverage(mk.normalise_funding(raw, F.col("user_id"))).select("symbol", "n_rows", "annualized_funding")


@query("SRC12 ST2", """WITH k AS (SELECT user_id AS symbol, epoch_ms(ts) // 3600000 * 3600000 AS ms, max(value) AS close FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT symbol, make_timestamp(ms * 1000) AS ts, close FROM k""", "close")
def normalised_klines(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'view'")
    ms = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000) * 3600000
    raw = e.select("user_id", F.when(F.col("event_id") % 2 == 0, ms * 1000).otherwise(ms).alias("open_time"), F.col("value").alias("open"), F.col("value").alias("high"),
                   F.col("value").alias("low"), F.col("value").alias("close"))
    return mk.normalise_klines(raw, F.col("user_id")).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "close")


def event_json(spark, sf):
    """Market messages derived from the events table: a trade, a quote and a depth update per event."""
    e = table(spark, sf, "events").filter("value > 0").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))).withColumn("v", F.col("value").cast("decimal(18,2)").cast("string"))
    lv = lambda sgn, k: F.array((F.col("value") * (1 + sgn * 0.001 * k)).cast("decimal(18,6)").cast("string"), (F.lit(1) + (F.col("event_id") + k) % 7).cast("string"))
    return e.withColumn("trade", F.to_json(F.struct(F.lit("aggTrade").alias("e"), F.col("user_id").cast("string").alias("s"), F.col("event_id").alias("a"), F.col("v").alias("p"),
                                                   F.lit("2.5").alias("q"), F.col("ms").alias("T"), (F.col("event_id") % 2 == 0).alias("m")))) \
            .withColumn("depth", F.to_json(F.struct(F.col("user_id").cast("string").alias("s"), F.col("ms").alias("E"), F.col("event_id").alias("u"),
                                                   F.array(*[lv(-1, k) for k in range(1, 7)]).alias("b"), F.array(*[lv(1, k) for k in range(1, 7)]).alias("a"))))


@query("SRC13 SRC14 FN7", """SELECT symbol, count(*) AS n, count_if(side = 'buy') AS n_buy, sum(price * 2.5) AS notional, avg(side_sign) AS mean_sign FROM (
  SELECT CAST(user_id AS VARCHAR) AS symbol, CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, value AS price, CASE WHEN event_id % 2 = 0 THEN -1.0 ELSE 1.0 END AS side_sign FROM events WHERE value > 0) GROUP BY symbol""", "notional mean_sign", digits=4)
def parsed_messages(spark, sf):
    j = event_json(spark, sf)
    t = mk.parse_agg_trade(j, "trade").select("symbol", "trade_id", "aggressor_sign")
    v = mk.parse_venue_messages(j.withColumn("venue", F.lit("v1")), "trade").select("sequence", "side", "price", "size")
    d = t.join(v, t.trade_id == v.sequence)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "buy").alias("n_buy"), F.sum(F.col("price") * F.col("size")).alias("notional"), F.avg("aggressor_sign").alias("mean_sign"))


@query("SRC15 SRC16 PRJ15", """WITH t AS (SELECT *, max(ts) OVER () AS top, min(ts) OVER () AS lo FROM events)
SELECT event_type, count(*) AS n_half_month, count_if(ts >= top - INTERVAL 1 MONTH) AS n_month, count_if((epoch_us(ts) // 60000000 - epoch_us(lo) // 60000000) % 15 = 0) AS n_thin
FROM t WHERE epoch_us(ts) >= epoch_us(top) - CAST(0.5 * 30.4375 * 86400000000 AS BIGINT) GROUP BY event_type""")
def recent_months(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    month = mk.last_months(e, "ts", 1).select("event_id", F.lit(1).alias("m"))
    lo = e.agg(F.min("ts").alias("lo"))
    d = mk.last_months(e, "ts", 0.5, exact_days=True).join(month, "event_id", "left").crossJoin(F.broadcast(lo))  # one-row side
    minute = lambda c: F.floor(F.unix_micros(c) / 60000000)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_half_month"), F.count("m").alias("n_month"), F.count_if((minute(F.col("ts")) - minute(F.col("lo"))) % 15 == 0).alias("n_thin"))


@query("SRC19 ST2", """WITH @bars, u AS (SELECT symbol, date, close, 0 AS a FROM bars UNION ALL SELECT symbol, date, close * 2, 1 FROM bars WHERE symbol % 3 = 0 AND day(date) < 10)
SELECT symbol, count(*) AS n, sum(close) AS total FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY a DESC) AS r FROM u) WHERE r = 1 GROUP BY symbol""", "total", digits=2)
def upsert_panel(spark, sf):
    b = bars(spark, sf).select("symbol", "date", "close")
    new = b.filter((F.col("symbol") % 3 == 0) & (F.dayofmonth("date") < 10)).withColumn("close", F.col("close") * 2)
    return mk.upsert(b, new, ["symbol", "date"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


@query("PRJ2 PRJ17 JN13", """WITH @bars, d AS (SELECT *, close * volume AS dv, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS f FROM bars),
k AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 250), top AS (SELECT symbol FROM d GROUP BY symbol ORDER BY avg(dv) DESC, symbol LIMIT 20)
SELECT symbol, count(*) AS n, avg(dv) AS mean_dv FROM d WHERE close >= 1000 AND dv >= 20000 AND abs(f) <= 0.5 AND date IN (SELECT date FROM k) AND symbol IN (SELECT symbol FROM top) GROUP BY symbol""", "mean_dv", digits=2)
def tradable_universe(spark, sf):
    d = bars(spark, sf).withColumn("dollar_volume", F.col("close") * F.col("volume")).withColumn("future_return_1", div(F.lead("close").over(by()), "close") - 1.0)
    top = d.groupBy("symbol").agg(F.avg("dollar_volume").alias("m")).orderBy(F.col("m").desc(), "symbol").limit(20).select("symbol")
    x = mk.filter_tradable(mk.last_dates(d, 250), 1000, 20000, 0.5)
    return x.join(top, "symbol", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("dollar_volume").alias("mean_dv"))


@query("PRJ3 PRJ5 FN2", """WITH @scored SELECT date, count(*) AS n, sum(y * w) AS wy, sum(pred * w) AS wp FROM scored WHERE w >= 0 AND pred <> 0.04 AND isfinite(y) GROUP BY date""", "wy wp")
def clean_scored(spark, sf):
    s = scored(spark, sf).withColumn("pred", F.when(F.col("pred") == 0.04, F.lit(float("nan"))).otherwise(F.col("pred")))
    d = s.filter(finite("pred") & finite("y") & finite("w") & (F.col("w") >= 0)).withColumn("pred", zero_fill("pred"))
    return d.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("w")).alias("wy"), F.sum(F.col("pred") * F.col("w")).alias("wp"))


@query("PRJ9 FN3", """WITH @bars SELECT symbol, date AS feature_as_of_date, CAST(date + CASE dayofweek(date) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END * INTERVAL 1 DAY AS DATE) AS execution_date, year(date) * 100 + quarter(date) AS yq,
  strftime(date, '%Y-%m') AS ym, CAST(date_trunc('month', date) AS DATE) AS month_start, CAST(isodow(date) AS INTEGER) AS weekday, CAST(extract(isoyear FROM date) * 100 + extract(week FROM date) AS BIGINT) AS iso_week FROM bars""")
def execution_dates(spark, sf):
    d = bars(spark, sf).withColumn("execution_date", next_weekday("date"))
    return d.select("symbol", F.col("date").alias("feature_as_of_date"), "execution_date", (F.year("date") * 100 + F.quarter("date")).cast("long").alias("yq"), F.date_format("date", "yyyy-MM").alias("ym"),
                    F.trunc("date", "MM").alias("month_start"), (F.weekday("date") + 1).alias("weekday"), (F.extract(F.lit("YEAROFWEEK"), F.col("date")) * 100 + F.weekofyear("date")).cast("long").alias("iso_week"))


@query("PRJ10 PRJ11 JN13", """WITH @bars, @membership, r AS (SELECT CASE WHEN symbol = 3 AND date >= DATE '1997-01-01' THEN 1003 WHEN symbol = 5 AND date >= DATE '1998-01-01' THEN 1005 ELSE symbol END AS s1, date, close, symbol AS old FROM bars),
r2 AS (SELECT CASE WHEN s1 = 1003 AND date >= DATE '1999-01-01' THEN 2003 ELSE s1 END AS symbol, date, close, old FROM r)
SELECT r2.symbol, count(*) AS n, count_if(coalesce(in_index, false)) AS n_member, min(r2.date) AS first_date FROM r2 LEFT JOIN membership m ON r2.old = m.symbol AND r2.date = m.date GROUP BY r2.symbol""")
def renamed_members(spark, sf):
    d = jn.point_in_time_members(bars(spark, sf), membership(spark, sf))
    d = jn.rename_tickers(d, [(3, 1003, "1997-01-01"), (5, 1005, "1998-01-01"), (1003, 2003, "1999-01-01")])
    return d.groupBy(F.col("symbol").cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.count_if("in_index").alias("n_member"), F.min("date").alias("first_date"))


@query("PRJ16", """SELECT event_type, count(*) AS n, avg(value) AS mean_value FROM events WHERE abs(value - 50) >= 5 AND CAST(json_extract(props, '$.k') AS DOUBLE) + 1 >= 10 AND value * 0.01 >= 2 * 0.1 GROUP BY event_type""", "mean_value")
def execution_filters(spark, sf):
    from quantloom.operators.backtest import execution_filters as keep
    d = table(spark, sf, "events").withColumns({"signal": F.col("value") - 50, "depth": F.from_json("props", "k INT")["k"].cast("double") + 1, "edge": F.col("value") * 0.01, "cost": F.lit(0.1), "relative_spread": F.lit(0.0)})
    d = keep(d, min_abs_signal=5.0, max_relative_spread=0.001, min_depth=10.0, edge_multiple=2.0)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


@query("PRJ18 PRJ19", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.005) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi, quantile_cont(l_extendedprice, 1.0 / 3) AS t1, quantile_cont(l_extendedprice, 2.0 / 3) AS t2 FROM lineitem)
SELECT CASE WHEN l_extendedprice <= t1 THEN 'low' WHEN l_extendedprice <= t2 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, avg(least(greatest(l_extendedprice, lo), hi)) AS winsorised_mean, max(least(greatest(l_extendedprice, lo), hi)) AS top
FROM lineitem, q GROUP BY 1""", "winsorised_mean top", digits=4)
def winsorised_terciles(spark, sf):
    from quantloom.operators.backtest import tercile, winsorise
    li = table(spark, sf, "lineitem").select("l_extendedprice")
    d = tercile(li, "l_extendedprice", "bucket", ("low", "mid", "high"))
    d = winsorise(d, ["l_extendedprice"], 0.005, 0.995)
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("l_extendedprice").alias("winsorised_mean"), F.max("l_extendedprice").alias("top"))


@query("JN3", """WITH @bars, u AS (SELECT *, symbol % 25 AS universe FROM bars), m AS (SELECT universe, count(DISTINCT symbol) AS k FROM u GROUP BY 1),
f AS (SELECT u.universe, date FROM u JOIN m USING (universe) GROUP BY u.universe, date, k HAVING count(*) = k),
a AS (SELECT u.universe, u.date, close / lag(close) OVER (PARTITION BY symbol ORDER BY u.date) - 1 AS ret FROM u JOIN f ON u.universe = f.universe AND u.date = f.date),
d AS (SELECT universe, date, coalesce(avg(ret), 0) * 0.01 AS ret, count(*) AS n FROM a GROUP BY 1, 2)
SELECT universe, date, ret, n, 100 * product(1 + ret * 1.0) OVER (PARTITION BY universe ORDER BY date) AS level FROM d""".replace("* 0.01 AS ret", "AS ret"), "ret level", digits=4)
def aligned_universe(spark, sf):
    return jn.aligned_universe(bars(spark, sf), F.col("symbol") % 25)


@query("JN4 JN8 JN9", """WITH @bars, dates AS (SELECT DISTINCT date FROM bars), rates AS (SELECT date, 0.01 + 0.0001 * day(date) AS annual_rate FROM dates WHERE day(date) % 10 = 5),
fits AS (SELECT date, CAST(year(date) * 100 + month(date) AS BIGINT) AS fit_id FROM dates WHERE day(date) = 20)
SELECT d.date, coalesce((SELECT arg_max(annual_rate, r.date) FROM rates r WHERE r.date <= d.date), 0) / 365 * 1e4 AS tbill, (coalesce((SELECT arg_max(annual_rate, r.date) FROM rates r WHERE r.date <= d.date), 0) - 0.0025) / 365 * 1e4 AS tbill_less,
 (SELECT max(fit_id) FROM fits f WHERE f.date <= d.date) AS fit_id, (SELECT max(fit_id) FROM fits f WHERE f.date < d.date) AS fit_id_strict FROM dates d""", "tbill tbill_less")
def asof_rates(spark, sf):
    dates = bars(spark, sf).select("date").distinct()
    rates = dates.filter(F.dayofmonth("date") % 10 == 5).withColumn("annual_rate", 0.01 + 0.0001 * F.dayofmonth("date"))
    fits = dates.filter(F.dayofmonth("date") == 20).withColumn("fit_id", (F.year("date") * 100 + F.month("date")).cast("long"))
    d = jn.cash_yield(dates, rates, "tbill").withColumnRenamed("cash_yield", "tbill")
    d = d.join(jn.cash_yield(dates, rates, "tbill_minus_25bps"), "date").withColumn("one", F.lit(1))
    d = jn.asof_backward(d, fits, "date", "fit_id")
    d = jn.asof_backward(d, fits.withColumnRenamed("fit_id", "fit_id_strict"), "date", "fit_id_strict", strict=True)
    return d.select("date", (F.col("tbill") * 1e4).alias("tbill"), (F.col("cash_yield") * 1e4).alias("tbill_less"), "fit_id", "fit_id_strict")


@query("JN5 JN4", """WITH @bars SELECT date, max(CASE WHEN symbol = 0 THEN close END) AS s0, max(CASE WHEN symbol = 1 THEN close END) AS s1, max(CASE WHEN symbol = 2 THEN close END) AS s2,
 max(CASE WHEN symbol = 3 THEN close END) AS s3 FROM bars GROUP BY date""", "s0 s1 s2 s3")
def date_panel(spark, sf):
    d = bars(spark, sf).select("date", F.concat(F.lit("s"), F.col("symbol")).alias("series"), "close")
    return jn.date_panel(d, "series", "close", ["s0", "s1", "s2", "s3"])


CARRY_SQL = """f AS (SELECT symbol, date, sum(fr) AS funding, count(*) AS n_settlements FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, (l_discount - 0.05) * 0.01 AS fr FROM lineitem) GROUP BY 1, 2),
p AS (SELECT b.symbol, b.date, 100 + symbol + 5 * sin(day(b.date)) AS spot, (100 + symbol + 5 * sin(day(b.date))) * (1 + 0.002 * cos(day(b.date) * 1.3)) AS perp, (100 + symbol + 5 * sin(day(b.date))) * 0.99 AS spot_low,
  (100 + symbol + 5 * sin(day(b.date))) * (1 + 0.002 * cos(day(b.date) * 1.3)) * (1.005 + 0.004 * sin(day(b.date) * 2.1)) AS perp_high FROM bars b)"""


def carry_inputs(spark, sf):
    b = bars(spark, sf)
    k = F.dayofmonth("date")
    spot = 100 + F.col("symbol") + 5 * F.sin(k)
    perp = spot * (1 + 0.002 * F.cos(k * F.lit(1.3)))
    s = b.select("symbol", "date", spot.alias("close"), (spot * 0.99).alias("low"))
    p = b.select("symbol", "date", perp.alias("close"), (perp * (1.005 + 0.004 * F.sin(k * F.lit(2.1)))).alias("high"))
    f = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("funding_time"), ((F.col("l_discount") - 0.05) * 0.01).alias("funding_rate"))
    return f, s, p


@query("JN6 WN41", f"""WITH @bars, {CARRY_SQL}, j AS (SELECT p.*, funding, n_settlements, perp / spot - 1 AS basis FROM p JOIN f ON p.symbol = f.symbol AND p.date = f.date)
SELECT symbol, date, funding, n_settlements, basis, coalesce(spot / lag(spot) OVER w - 1, 0) - coalesce(perp / lag(perp) OVER w - 1, 0) AS price_pnl, perp_high / spot_low - 1 - coalesce(lag(basis) OVER w, basis) AS adverse_dbasis
FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date)""", "funding basis price_pnl adverse_dbasis")
def carry_panel(spark, sf):
    return jn.adverse_basis(jn.carry_panel(*carry_inputs(spark, sf))).select("symbol", "date", "funding", "n_settlements", "basis", "price_pnl", "adverse_dbasis")


@query("JN7", """WITH e AS (SELECT user_id AS symbol, make_timestamp(epoch_ms(ts) // 3600000 * 3600000000) AS ts, max(value) AS v FROM events WHERE value > 0 GROUP BY 1, 2)
SELECT symbol, ts, v * 1e-4 AS funding_rate, v AS spot, v * 1.01 AS perp FROM e WHERE hour(ts) % 8 = 0""", "funding_rate spot perp")
def carry_panel_hourly(spark, sf):
    e = table(spark, sf, "events").filter("value > 0").groupBy(F.col("user_id").alias("symbol"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(F.max("value").alias("v"))
    late = F.timestamp_millis(F.unix_millis("ts") + F.col("symbol") % 3)  # settlements stamped 0 to 2 ms late
    f = e.filter(F.hour("ts") % 8 == 0).select("symbol", late.alias("funding_time"), (F.col("v") * 1e-4).alias("funding_rate"))
    return jn.carry_panel_hourly(f, e.withColumnRenamed("v", "close"), e.withColumn("close", F.col("v") * 1.01)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("JN11 FN4 JN12 AG16 AG17", """WITH @ticks, b AS (SELECT symbol, date_trunc('minute', event_time) AS ts, arg_max(price, (event_time, trade_id)) AS close FROM ticks GROUP BY 1, 2),
r AS (SELECT symbol, trade_id, event_time, 5 + trade_id % 600 AS h FROM ticks),
x AS (SELECT r.*, date_trunc('minute', event_time) AS en, CASE WHEN epoch_us(event_time) % 60000000 = 0 THEN event_time ELSE date_trunc('minute', event_time) + INTERVAL 1 MINUTE END + CAST(h AS INTEGER) * INTERVAL 1 MINUTE AS xx FROM r)
SELECT x.symbol, x.trade_id, CASE WHEN c.close > 0 AND e.close > 0 THEN c.close / e.close - 1 END AS realized_return, CAST(coalesce(sign(CASE WHEN c.close > 0 AND e.close > 0 THEN c.close / e.close - 1 END), 0) AS INTEGER) AS realized_direction
FROM x LEFT JOIN b e ON x.symbol = e.symbol AND x.en = e.ts LEFT JOIN b c ON x.symbol = c.symbol AND x.xx = c.ts""", "realized_return")
def forward_returns(spark, sf):
    t = ticks(spark, sf)
    b = tk.minute_bars(t)
    r = t.select("symbol", "trade_id", F.col("event_time").alias("fill_ts"), (5 + F.col("trade_id") % 600).alias("horizon_minutes"))
    return jn.forward_returns(r, b).select("symbol", "trade_id", "realized_return", "realized_direction")


SIGNALS_SQL = """sg AS (SELECT o_orderkey AS signal_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 3 - 1 AS INTEGER) AS predicted_direction, CAST((o_orderkey * 7) % 3 - 1 AS INTEGER) AS realized_direction, (o_custkey % 10) / 10.0 AS weight,
  CASE o_orderkey % 5 WHEN 0 THEN 'veto' WHEN 1 THEN NULL ELSE 'pass' END AS d0, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS fill_price, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 11 - 5) * 0.001 END AS realized_return FROM orders)"""


def signal_tables(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    preds = o.select(k.alias("signal_id"), F.to_date("o_orderdate").alias("date"), (k % 3 - 1).cast("int").alias("predicted_direction"), ((k * 7) % 3 - 1).cast("int").alias("realized_direction"),
                     ((F.col("o_custkey") % 10) / 10.0).alias("weight"), F.when(k % 6 != 0, (k % 11 - 5) * 0.001).alias("realized_return"))
    verdicts = o.filter(k % 5 != 1).select(k.alias("signal_id"), F.when(k % 5 == 0, "veto").otherwise("pass").alias("decision"))
    fills = o.filter(k % 4 != 0).select(k.alias("signal_id"), F.col("o_totalprice").alias("fill_price"), F.lit(1.0).alias("fee"))
    return preds, verdicts, fills


@query("JN12 AG16", f"""WITH {SIGNALS_SQL} SELECT sum(CASE WHEN predicted_direction <> 0 AND weight > 0 AND predicted_direction = realized_direction THEN weight ELSE 0 END) / sum(CASE WHEN predicted_direction <> 0 AND weight > 0 THEN weight END) AS hit_rate,
  count_if(predicted_direction <> 0 AND weight > 0) AS n_signals, count_if(predicted_direction <> 0 AND weight > 0 AND predicted_direction = realized_direction) AS n_hits, avg(CASE WHEN d0 IS NULL OR d0 = 'veto' THEN 1.0 ELSE 0.0 END) AS governor_block_rate FROM sg""", "hit_rate governor_block_rate")
def signal_hit_rate(spark, sf):
    return ag.hit_and_block_rate(jn.assemble_signals(*signal_tables(spark, sf)))


@query("AG17 JN12", f"""WITH {SIGNALS_SQL}, d AS (SELECT date, sum(CASE WHEN fill_price IS NOT NULL AND predicted_direction <> 0 AND realized_return IS NOT NULL THEN predicted_direction * abs(weight * fill_price) * realized_return - 1 ELSE 0 END) AS daily_pnl, count(*) AS n_rows FROM sg GROUP BY date)
SELECT date, daily_pnl, n_rows, daily_pnl / 1e6 AS daily_pnl_pct, abs(least(daily_pnl / 1e6, 0)) AS daily_dd_pct,
 CASE WHEN count(daily_pnl) OVER w >= 2 THEN coalesce(avg(daily_pnl / 1e6) OVER w / nullif(stddev_samp(daily_pnl / 1e6) OVER w, 0) * sqrt(252), 0) END AS rolling_sharpe FROM d WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""", "daily_pnl daily_pnl_pct daily_dd_pct rolling_sharpe", digits=4)
def daily_fill_pnl(spark, sf):
    d = ag.daily_fill_pnl(jn.assemble_signals(*signal_tables(spark, sf)), 1e6)
    return ag.rolling_sharpe_by_days(d, "daily_pnl_pct", 30)


@query("JN14 ST4 FN5", """WITH l AS (SELECT DISTINCT c_custkey AS k, lower(c_name) || ' inc' AS n FROM customer), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = 0), rn AS (SELECT DISTINCT lower(c_name) || ' inc' AS n FROM customer WHERE c_custkey % 5 = 0)
SELECT count(*) AS n_keys, count_if(k IN (SELECT k FROM r)) AS by_id, count_if(k NOT IN (SELECT k FROM r) AND n IN (SELECT n FROM rn)) AS by_name, count_if(k NOT IN (SELECT k FROM r) AND n NOT IN (SELECT n FROM rn)) AS unmapped,
 1 - count_if(k NOT IN (SELECT k FROM r) AND n NOT IN (SELECT n FROM rn)) / count(*) AS mapped_share, 1 - count_if(k NOT IN (SELECT k FROM r) AND n NOT IN (SELECT n FROM rn)) / count(*) >= 0.9 AS gate_pass FROM l""", "mapped_share")
def registry_overlap(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    left = c.select(F.col("c_custkey").alias("key"), F.concat("c_name", F.lit(", Inc.")).alias("name"))
    right = o.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.lit("-").alias("name")).distinct().unionByName(
        c.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 10_000_000_000).alias("key"), F.upper(F.concat("c_name", F.lit(" Corp"))).alias("name")))
    return jn.registry_overlap(left, right, "key", "name")


@query("JN15 FN8", """WITH @bars, @exits, l AS (SELECT symbol, max(date) AS exit_date FROM bars GROUP BY symbol), g AS (SELECT * FROM l WHERE exit_date < (SELECT max(exit_date) FROM l))
SELECT g.symbol, g.exit_date, coalesce(exit_reason, 'unknown') AS exit_reason, coalesce(terminal_return_known, false) AS terminal_return_captured, terminal_return_value, CASE WHEN e.symbol IS NOT NULL THEN 'exits_feed' ELSE 'panel_inferred' END AS classification_source,
 CASE WHEN exit_reason = 'bankruptcy' THEN CASE WHEN terminal_return_known THEN 'delisted_captured' ELSE 'delisted_missing' END WHEN exit_reason IN ('merger', 'acquired') THEN CASE WHEN terminal_return_known THEN 'merger_captured' ELSE 'merger_missing' END ELSE 'unknown_exit' END AS classification
FROM g LEFT JOIN exits e ON g.symbol = e.symbol""", "terminal_return_value")
def exit_audit(spark, sf):
    return jn.audit_exits(bars(spark, sf), exits(spark, sf))


@query("DQ5 JN15", """WITH @bars, @exits, l AS (SELECT symbol, max(date) AS exit_date FROM bars GROUP BY symbol), g AS (SELECT * FROM l WHERE exit_date < (SELECT max(exit_date) FROM l)), k AS (SELECT g.symbol, coalesce(terminal_return_known AND exit_reason IN ('bankruptcy', 'merger', 'acquired'), false) AS cap,
 coalesce(exit_reason, 'x') NOT IN ('bankruptcy', 'merger', 'acquired') AS unk FROM g LEFT JOIN exits e ON g.symbol = e.symbol)
SELECT count_if(cap) AS captured, count(*) AS total, count_if(unk) AS unknown, CASE WHEN count(*) = 0 THEN 1 ELSE count_if(cap) / count(*) END AS capture_ratio, CASE WHEN count_if(cap) / count(*) >= 0.95 AND count_if(unk) = 0 THEN 'pit_safe' ELSE 'partial_pit_universe' END AS quality_label FROM k""", "capture_ratio")
def capture_quality(spark, sf):
    return jn.point_in_time_label(jn.capture_ratio(jn.audit_exits(bars(spark, sf), exits(spark, sf))), "vendor")


@query("JN16 AG15", """WITH d AS (SELECT p_brand AS k, min(p_partkey) AS v FROM part GROUP BY 1), f AS (SELECT l_partkey, l_extendedprice FROM lineitem)
SELECT coalesce(CAST(d.v AS VARCHAR), p_brand) AS v, sum(l_extendedprice) AS pnl FROM f JOIN part ON l_partkey = p_partkey LEFT JOIN d ON p_brand = d.k GROUP BY 1 ORDER BY pnl DESC, v LIMIT 10""", "pnl", digits=2)
def first_dimension_top(spark, sf):
    p = table(spark, sf, "part")
    facts = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("k"), F.col("l_extendedprice").alias("pnl"))
    dim = p.select(F.col("p_brand").alias("k"), F.col("p_partkey").cast("string").alias("v"), "p_partkey")
    return ag.top_contributors(jn.first_dimension(facts, dim, "k", "v", ["p_partkey"]), "v", 10)


@query("JN17 JN18", """WITH @bars, s AS (SELECT symbol, date, sign(close / open - 1) AS sig FROM bars), p AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) / 500000 AS pr FROM orders GROUP BY 1, 2)
SELECT s.symbol, sum(CASE WHEN day(s.date) % 3 = 0 THEN sig ELSE 0 END) AS gated, sum(CASE WHEN coalesce(pr, 0) >= 0.3 THEN sig ELSE 0 END) AS filtered FROM s LEFT JOIN p ON s.symbol = p.symbol AND s.date = p.date GROUP BY s.symbol""", "gated filtered")
def gated_signals(spark, sf):
    s = bars(spark, sf).select("symbol", "date", F.signum(F.col("close") / F.col("open") - 1).alias("signal"))
    regime = s.select("date").distinct().filter(F.dayofmonth("date") % 2 == 0).unionByName(s.select("date").distinct().filter(F.dayofmonth("date") % 2 == 1)).withColumn("on", F.dayofmonth("date") % 3 == 0)
    probs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg((F.max("o_totalprice") / 500000).alias("probability"))
    a = jn.gate_by_regime(s, regime, "on").groupBy("symbol").agg(F.sum("signal").alias("gated"))
    b = jn.keep_by_probability(s, probs, 0.3).groupBy("symbol").agg(F.sum("signal").alias("filtered"))
    return a.join(b, "symbol")


@query("JN21", """WITH @ticks, m AS (SELECT symbol, CAST(event_time AS DATE) AS date, arg_max(price, (event_time, trade_id)) AS mine, avg(price) AS theirs FROM ticks GROUP BY 1, 2), d AS (SELECT abs(mine / theirs - 1) AS rel FROM m)
SELECT count(*) AS n_days, avg(rel) AS mean_diff, quantile_cont(rel, 0.99) AS p99_diff, max(rel) AS max_diff FROM d""", "mean_diff p99_diff max_diff")
def close_crosscheck(spark, sf):
    t = ticks(spark, sf)
    daily = t.groupBy("symbol", F.to_date("event_time").alias("date")).agg(F.avg("price").alias("close"))
    return jn.crosscheck_close(t, daily)


@query("JN22", """WITH @scored SELECT count(*) AS n, max(abs(y - (y + 1e-7))) < 1e-5 AS aligned FROM scored""")
def reattached_keys(spark, sf):
    s = scored(spark, sf)
    s = s.withColumn("copy", F.row_number().over(W.partitionBy("row_id").orderBy("y", "pred", "w")))
    _, check = jn.reattach_keys(s.withColumn("y", F.col("y") + 1e-7), s, ["row_id", "copy"], ["y", "w"])
    return check.select("n", "aligned")


@query("AG1 WN38 MT2", f"""WITH @bars, {RET}, d AS (SELECT date, avg(ret) AS r FROM ret GROUP BY date)
SELECT 'month' AS kind, strftime(date, '%Y-%m') AS period, product(1 + r) - 1 AS total_return, count(*) AS n_periods FROM d GROUP BY 2 UNION ALL SELECT 'year', strftime(date, '%Y'), product(1 + r) - 1, count(*) FROM d GROUP BY 2""", "total_return")
def period_returns(spark, sf):
    d = small_returns(spark, sf).groupBy("date").agg(F.avg("ret").alias("r"))
    return ag.period_returns(d, "r", "month").select(F.lit("month").alias("kind"), "*").unionByName(ag.period_returns(d, "r", "year").select(F.lit("year").alias("kind"), "*"))


@query("AG2", f"""WITH @bars, {RET} SELECT CASE WHEN symbol % 2 = 0 THEN 'even' ELSE 'odd' END AS variant, date, avg(CASE WHEN ret <> 0 THEN ret END) AS mean_return, sum(CASE WHEN ret <> 0 THEN ret END) AS sum_return, count(CASE WHEN ret <> 0 THEN ret END) AS n_trades FROM ret GROUP BY 1, 2""", "mean_return sum_return")
def book_by_date(spark, sf):
    d = small_returns(spark, sf).withColumn("variant", F.when(F.col("symbol") % 2 == 0, "even").otherwise("odd"))
    return ag.book_by_date(d, "ret", taken=F.col("ret") != 0)


@query("AG3", """WITH @bars, @sectors, p AS (SELECT date, sector, volume * CASE WHEN b.symbol % 2 = 0 THEN 1 ELSE -1 END AS x FROM bars b JOIN sectors s ON b.symbol = s.symbol)
SELECT date, sum(x) AS net, sum(abs(x)) AS gross, sum(greatest(x, 0)) AS long, sum(greatest(-x, 0)) AS short, sum(CASE WHEN sector = 'ASIA' THEN greatest(x, 0) ELSE 0 END) AS long_ASIA, sum(CASE WHEN sector = 'ASIA' THEN greatest(-x, 0) ELSE 0 END) AS short_ASIA,
 sum(CASE WHEN sector = 'EUROPE' THEN greatest(x, 0) ELSE 0 END) AS long_EUROPE, sum(CASE WHEN sector = 'EUROPE' THEN greatest(-x, 0) ELSE 0 END) AS short_EUROPE FROM p GROUP BY date""", "net gross long short long_ASIA short_ASIA long_EUROPE short_EUROPE")
def daily_exposures(spark, sf):
    p = bars(spark, sf).join(sectors(spark, sf), "symbol").withColumn("signed_notional", F.col("volume") * F.when(F.col("symbol") % 2 == 0, 1).otherwise(-1))
    return ag.exposures(p, ["ASIA", "EUROPE"])


@query("AG4", f"""WITH @bars, {RET}, d AS (SELECT date, sum(ret) AS price_pnl, sum(abs(ret)) * 0.01 AS commission, count(*) * 0.001 AS borrow FROM ret GROUP BY date)
SELECT sum(price_pnl) / 1000 / count(*) * 1e4 AS price_pnl_bps, sum(commission) / 1000 / count(*) * 1e4 AS commission_bps, sum(borrow) / 1000 / count(*) * 1e4 AS borrow_bps, count(*) AS n_days FROM d""", "price_pnl_bps commission_bps borrow_bps")
def pnl_decomposition(spark, sf):
    d = small_returns(spark, sf).groupBy("date").agg(F.sum("ret").alias("price_pnl"), (F.sum(F.abs("ret")) * 0.01).alias("commission"), (F.count(F.lit(1)) * 0.001).alias("borrow"))
    return ag.pnl_decomposition(d, ["price_pnl", "commission", "borrow"], 1000.0)


METRICS_SQL = f"""m AS (SELECT symbol, symbol % 7 AS family, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, product(1 + ret) - 1 AS total_return, min(ret) AS max_drawdown FROM ret GROUP BY 1, 2)"""


def symbol_metrics(spark, sf):
    return small_returns(spark, sf).groupBy("symbol").agg(ag.sharpe_of("ret").alias("sharpe"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.min("ret").alias("max_drawdown")).withColumn("family", F.col("symbol") % 7)


@query("AG5", f"WITH @bars, {RET}, {METRICS_SQL} SELECT family, avg(sharpe) AS sharpe_mean, max(sharpe) AS sharpe_max, stddev_samp(sharpe) AS sharpe_std, avg(total_return) AS ret_mean, min(max_drawdown) AS mdd_worst, count(*) AS n_strategies FROM m GROUP BY family",
       "sharpe_mean sharpe_max sharpe_std ret_mean mdd_worst")
def family_leaderboard(spark, sf):
    return ag.leaderboard(symbol_metrics(spark, sf), "family")


@query("AG6", f"""WITH @bars, {RET}, {METRICS_SQL}, e AS (SELECT sharpe, min(sharpe) OVER () AS lo, max(sharpe) OVER () AS hi FROM m), h AS (SELECT CAST(least(floor((sharpe - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1)
SELECT bin, n, (SELECT quantile_cont(sharpe, 0.05) FROM m) AS p5, (SELECT quantile_cont(sharpe, 0.5) FROM m) AS p50, (SELECT quantile_cont(sharpe, 0.99) FROM m) AS p99, (SELECT avg(sharpe) FROM m) AS mean FROM h""", "p5 p50 p99 mean")
def sharpe_histogram(spark, sf):
    m = symbol_metrics(spark, sf)
    return ag.histogram(m, "sharpe").crossJoin(ag.percentile_summary(m, "sharpe").select("p5", "p50", "p99", "mean"))  # one-row side


@query("AG7", f"""WITH @bars, {RET}, t AS (SELECT CASE WHEN volume < 20 THEN 'thin' WHEN volume < 40 THEN 'normal' ELSE 'deep' END AS bucket, ret * 0.01 AS gross, 0.0002 AS cost, ret * 0.01 - 0.0002 AS net FROM ret)
SELECT bucket, count(*) AS n_trades, avg(gross) AS mean_gross, avg(net) AS mean_net, avg(cost) AS mean_cost, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END) AS hit_rate, sum(ln(1 + net)) AS log_compounded FROM t GROUP BY bucket""", "mean_gross mean_net mean_cost hit_rate log_compounded", digits=5)
def trade_buckets(spark, sf):
    t = small_returns(spark, sf).withColumns({"bucket": F.when(F.col("volume") < 20, "thin").when(F.col("volume") < 40, "normal").otherwise("deep"), "gross": F.col("ret") * 0.01, "cost": F.lit(0.0002), "net": F.col("ret") * 0.01 - 0.0002})
    # the compounded product over all trades is huge here, so its logarithm is compared
    return ag.trade_buckets(t, "bucket").drop("compounded")


@query("AG9 AG10 AG11", f"""WITH @bars, {RET}, m AS (SELECT strftime(date, '%Y-%m') AS k, sum(ret) AS v FROM ret GROUP BY 1), y AS (SELECT year(date) AS k, sum(ret) AS v FROM ret GROUP BY 1), d AS (SELECT date AS k, sum(ret) AS v FROM ret GROUP BY 1), s AS (SELECT symbol AS k, sum(ret) AS v FROM ret GROUP BY 1)
SELECT (SELECT max(v) / sum(v) FROM s) AS stock_share, (SELECT max(abs(v)) / sum(abs(v)) FROM m) AS month_share, (SELECT max(abs(v)) / sum(abs(v)) FROM y) AS year_share, (SELECT arg_max(k, (v, k)) FROM d) AS best_date, (SELECT max(v) / sum(greatest(v, 0)) FROM d) AS best_day_share,
 (SELECT max(ret) / sum(greatest(ret, 0)) FROM ret) AS best_trade_share, (SELECT max(v) / sum(greatest(v, 0)) FROM s) AS best_symbol_share, (SELECT sum(v) - max(v) FROM d) AS pnl_without_best_day""", "stock_share month_share year_share best_day_share best_trade_share best_symbol_share pnl_without_best_day")
def concentration(spark, sf):
    p = small_returns(spark, sf).select("symbol", "date", F.col("ret").alias("pnl"))
    stock = ag.signed_share(p, "symbol").withColumnRenamed("max_share", "stock_share")
    month = ag.abs_share_by_period(p, F.date_format("date", "yyyy-MM")).agg(F.max("share").alias("month_share"))
    year = ag.abs_share_by_period(p, F.year("date")).agg(F.max("share").alias("year_share"))
    pos = ag.positive_concentration(p).drop("day_blocker", "trade_blocker", "symbol_blocker")
    return stock.crossJoin(month).crossJoin(year).crossJoin(pos)  # four one-row tables


@query("AG12 AG13", f"""WITH @bars, {RET}, d AS (SELECT date, avg(ret) AS net FROM ret GROUP BY date)
SELECT CAST(year(date) AS INTEGER) AS year, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, avg(net) * 252 AS annual_return, sum(net) AS total, count(*) AS n_days, (SELECT avg(net) / stddev_samp(net) * sqrt(252) FROM d WHERE year(date) <> 1998) AS sharpe_ex_1998,
 (SELECT avg(net) / stddev_samp(net) * sqrt(252) FROM d WHERE year(date) < 2000) AS sharpe_pre_2000 FROM d GROUP BY 1""", "sharpe annual_return total sharpe_ex_1998 sharpe_pre_2000")
def per_year(spark, sf):
    d = ag.pooled_book(small_returns(spark, sf).withColumnRenamed("ret", "net"), ["net"])
    return ag.per_year(d, "net").crossJoin(ag.excluding_years(d, "net", [1998], 2000))  # one-row side


@query("AG14", f"""WITH @bars, @sectors, {RET}, s AS (SELECT sector, date, avg(ret) AS r FROM ret JOIN sectors USING (symbol) GROUP BY 1, 2), g AS (SELECT d.date, k.sector, coalesce(r, 0) AS r FROM (SELECT DISTINCT date FROM s) d CROSS JOIN (SELECT DISTINCT sector FROM sectors) k LEFT JOIN s ON s.date = d.date AND s.sector = k.sector),
v AS (SELECT *, 1 / greatest(coalesce(CASE WHEN count(r) OVER w >= 60 THEN stddev_samp(r) OVER w END, 0.02), 0.0005) AS iv FROM g WINDOW w AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT date, sum(iv * r) / sum(iv) AS net_return FROM v GROUP BY date""", "net_return", digits=8)
def equal_risk_sleeves(spark, sf):
    s = sectors(spark, sf)
    names = sorted(r["r_name"] for r in table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(
        table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("r_name").distinct().collect())  # a handful of sectors
    d = small_returns(spark, sf).join(s, "symbol").groupBy("sector", "date").agg(F.avg("ret").alias("ret"))
    return ag.equal_risk(d, names)


@query("AG18", f"""WITH @bars, {RET}, d AS (SELECT date, avg(ret) AS r FROM ret GROUP BY date), e AS (SELECT date, 1000 * product(1 + r) OVER (ORDER BY date) AS equity, abs(r) AS cost FROM d),
m AS (SELECT strftime(date, '%Y-%m') AS month, arg_min(equity, date) AS a, arg_max(equity, date) AS b FROM e GROUP BY 1)
SELECT count(*) AS n_months, avg(b / a - 1) AS mean, quantile_cont(b / a - 1, 0.5) AS median, max(b / a - 1) AS best, min(b / a - 1) AS worst, avg(CASE WHEN b > a THEN 1.0 ELSE 0 END) AS positive_share FROM m""", "mean median best worst positive_share")
def monthly_equity(spark, sf):
    from quantloom.operators.features import drawdown
    d = small_returns(spark, sf).groupBy("date").agg(F.avg("ret").alias("r")).withColumn("book", F.lit(0))
    e = drawdown(d, "r", ["book"], ["date"]).withColumn("equity", F.col("equity") * 1000).withColumn("cost", F.abs("r"))
    return ag.monthly_summary(ag.monthly_equity(e))


@query("WN22", """WITH @ticks, a AS (SELECT symbol, trade_id, event_time, price, size, aggressor_sign, size * aggressor_sign AS ss, price / lag(price) OVER (PARTITION BY symbol ORDER BY event_time, trade_id) - 1 AS r FROM ticks),
b AS (SELECT *, lead(price, 5) OVER k AS fp FROM a WINDOW k AS (PARTITION BY symbol ORDER BY event_time, trade_id))
SELECT trade_id, r AS price_return_1, sum(ss) OVER w10 / sum(size) OVER w10 AS ofi_10, price / lag(price, 10) OVER k - 1 AS ret_10, CASE WHEN count(r) OVER w10 >= 2 THEN stddev_samp(r) OVER w10 END AS realized_vol_10, avg(aggressor_sign) OVER w10 AS signed_count_imb_10,
 price * (1 - 1e-4) AS best_bid, fp / price - 1 AS future_mid_return_5, fp * (1 + 1e-4) AS future_best_ask_5 FROM b
WINDOW k AS (PARTITION BY symbol ORDER BY event_time, trade_id), w10 AS (PARTITION BY symbol ORDER BY event_time, trade_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
       "price_return_1 ofi_10 ret_10 realized_vol_10 signed_count_imb_10 best_bid future_mid_return_5 future_best_ask_5", digits=5)
def trade_flow_features(spark, sf):
    d = tk.trade_flow_features(ticks(spark, sf), horizons=(5,), windows=(10,), ties=["trade_id"])
    return d.select("trade_id", "price_return_1", "ofi_10", "ret_10", "realized_vol_10", "signed_count_imb_10", "best_bid", "future_mid_return_5", "future_best_ask_5")


@query("WN20 WN21", """WITH @ticks, a AS (SELECT symbol, trade_id, event_time, price * (1 - 0.0005 * size) AS bid, price * (1 + 0.0005 * size) AS ask, size AS bs, 101 - size AS zs FROM ticks), b AS (SELECT *, (bid + ask) / 2 AS mid, (bs - zs) / (bs + zs) AS imb, (ask * bs + bid * zs) / (bs + zs) AS micro FROM a),
c AS (SELECT *, mid / lag(mid) OVER k - 1 AS r, lead(mid, 5) OVER k AS fm, lead(bid, 5) OVER k AS fb, lead(ask, 5) OVER k AS fa, row_number() OVER k AS i FROM b WINDOW k AS (PARTITION BY symbol ORDER BY event_time, trade_id))
SELECT trade_id, imb AS l1_imbalance, micro / mid - 1 AS microprice_deviation, (ask - bid) / mid AS relative_spread, CASE WHEN count(r) OVER w >= 2 THEN stddev_samp(r) OVER w END AS realized_vol_10, least(i, 10) AS event_count_10, fm / mid - 1 AS future_mid_return_5,
 fb / ask - 1 AS future_taker_long_return_5, bid / fa - 1 AS future_taker_short_return_5, CAST(fm > mid AS TINYINT) AS mid_direction_up_5 FROM c WINDOW w AS (PARTITION BY symbol ORDER BY event_time, trade_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
       "l1_imbalance microprice_deviation relative_spread realized_vol_10 future_mid_return_5 future_taker_long_return_5 future_taker_short_return_5")
def quote_features(spark, sf):
    z = F.col("size")
    q = ticks(spark, sf).select("symbol", "event_time", "trade_id", (F.col("price") * (1 - 0.0005 * z)).alias("best_bid"), (F.col("price") * (1 + 0.0005 * z)).alias("best_ask"), z.alias("best_bid_size"), (101 - z).alias("best_ask_size"))
    d = tk.quote_features(q, horizons=(5,), windows=(10,), ties=["trade_id"])
    return d.select("trade_id", "l1_imbalance", "microprice_deviation", "relative_spread", "realized_vol_10", "event_count_10", "future_mid_return_5", "future_taker_long_return_5", "future_taker_short_return_5", "mid_direction_up_5")


@query("WN23 SRC13 FN7", """WITH @ticks, a AS (SELECT symbol, trade_id, event_time, [CAST(CAST(price * (1 - 0.001 * k) AS DECIMAL(18, 6)) AS DOUBLE) for k in range(1, 7)] AS bp, [CAST(CAST(price * (1 + 0.001 * k) AS DECIMAL(18, 6)) AS DOUBLE) for k in range(1, 7)] AS ap, [1.0 + (trade_id + k) % 7 for k in range(1, 7)] AS q FROM ticks),
b AS (SELECT *, (bp[1] + ap[1]) / 2 AS mid FROM a)
SELECT trade_id, mid AS mid_price, list_sum(q[1:5]) AS bid_depth_5, list_sum(q) AS ask_depth_10, (ap[1] * q[1] + bp[1] * q[1]) / (2 * q[1]) AS microprice_l1, (ap[1] - bp[1]) / mid AS relative_spread, lead(mid, 5) OVER k / mid - 1 AS future_mid_return_5, lead(ap[1], 5) OVER k AS future_best_ask_5
FROM b WINDOW k AS (PARTITION BY symbol ORDER BY event_time, trade_id)""", "mid_price bid_depth_5 ask_depth_10 microprice_l1 relative_spread future_mid_return_5 future_best_ask_5", digits=4)
def depth_features(spark, sf):
    j = event_json(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("tt"), "depth")
    d = mk.parse_depth_update(j, "depth").withColumnRenamed("update_id", "trade_id").drop("event_time").join(j.select(F.col("event_id").alias("trade_id"), F.col("tt").alias("event_time")), "trade_id")
    f = tk.depth_features(d, horizons=(5,), depths=(1, 5, 10), ties=["trade_id"])
    return f.select("trade_id", "mid_price", "bid_depth_5", "ask_depth_10", "microprice_l1", "relative_spread", "future_mid_return_5", "future_best_ask_5")


@query("SS12", """WITH @ticks SELECT symbol, time_bucket(INTERVAL 1 HOUR, event_time) AS ts, arg_min(price, (event_time, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (event_time, trade_id)) AS close, sum(size) AS volume, count(*) AS n_trades FROM ticks GROUP BY 1, 2""",
       "open high low close volume")
def bars_from_ticks(spark, sf):
    return tk.minute_bars(ticks(spark, sf), "1 hour").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("FN1 FN6", """WITH @bars SELECT symbol, date, sha256(CAST(symbol AS VARCHAR) || '|' || CAST(date AS VARCHAR)) AS key_hash, ln(1 + volume) AS l, sqrt(abs(open - close)) AS s, sin(volume) AS sn, CAST(sign(close - open) AS DOUBLE) AS sg, least(greatest(close / open, 0.9), 1.1) AS clipped,
 (coalesce(nullif(open, close), 0) + close) / (CASE WHEN open = close THEN 1 ELSE 2 END) AS mean_two, CASE WHEN symbol % 3 = 0 THEN 25.0 WHEN symbol % 3 = 1 THEN 100.0 ELSE 500.0 END::DOUBLE AS tier_bps FROM bars""", "l s sn clipped mean_two", digits=5)
def scalar_functions(spark, sf):
    c, o = F.col("close"), F.col("open")
    tier = F.element_at(F.array(F.lit("easy"), F.lit("general"), F.lit("hard")), (F.col("symbol") % 3 + 1).cast("int"))
    return bars(spark, sf).select("symbol", "date", F.sha2(F.concat_ws("|", F.col("symbol").cast("string"), F.col("date").cast("string")), 256).alias("key_hash"), F.log1p("volume").alias("l"), F.sqrt(F.abs(o - c)).alias("s"),
                                  F.sin("volume").alias("sn"), F.signum(c - o).alias("sg"), clip(div(c, o), 0.9, 1.1).alias("clipped"), mean_of(F.nullif(o, c), c).alias("mean_two"), code_map(tier, {"easy": 25.0, "general": 100.0, "hard": 500.0}).alias("tier_bps"))
