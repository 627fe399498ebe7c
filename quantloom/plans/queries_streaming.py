"""Streaming queries: file streams over the landed tables, run until their input is used up, and batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.plans.registry import query
from quantloom.plans.views import table, ticks
from quantloom.sources.market import keep_last
from quantloom.streaming import execution as ex
from quantloom.streaming import record as rc


def tick_stream(spark, sf):
    ev = rc.source(spark, f"{sf}/events.parquet").filter("value > 0")
    return ev.select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"), (F.from_json("props", "k INT")["k"].cast("double") + 1).alias("size"))


@query("SS1 SS2", """WITH @ticks SELECT symbol, count(*) AS n, sum(price) AS total, min(event_time) AS first_time, max(event_time) AS last_time FROM ticks WHERE event_time >= TIMESTAMP '2024-01-05' AND event_time < TIMESTAMP '2024-01-20 12:00:00' GROUP BY symbol""", "total", digits=4)
def recorded_replay(spark, sf):
    rec = rc.record_ticks(tick_stream(spark, sf))
    d = rc.replay(rec, "2024-01-05", "2024-01-20 12:00:00")
    ts = lambda c: c.cast("timestamp_ntz")
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"), ts(F.min("event_time")).alias("first_time"), ts(F.max("event_time")).alias("last_time"))


@query("SS3", """WITH @ticks, l AS (SELECT symbol, max(event_time) AS last_tick FROM ticks GROUP BY symbol) SELECT symbol, last_tick, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(last_tick) / 1e6 AS gap_seconds, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(last_tick) / 1e6 <= CASE WHEN symbol % 2 = 0 THEN 3600 ELSE 86400 END AS fresh FROM l""", "gap_seconds", digits=3)
def stream_heartbeat(spark, sf):
    u = rc.run_updates(rc.heartbeat(tick_stream(spark, sf)), "heartbeat")
    last = keep_last(u, ["symbol"], ["_epoch"]).drop("_epoch")
    d = rc.freshness(last, F.lit("2024-01-31").cast("timestamp"), F.col("symbol") % 2 == 0, 3600, 86400)
    return d.withColumn("last_tick", F.col("last_tick").cast("timestamp_ntz"))


@query("SS12", """WITH @ticks, b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, event_time) AS ts, arg_min(price, (event_time, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (event_time, trade_id)) AS close, sum(size) AS volume, count(*) AS n_trades FROM ticks GROUP BY 1, 2)
SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT to_timestamp(floor(epoch(max(event_time)) * 1000) / 1000)::TIMESTAMP - INTERVAL 10 MINUTE FROM ticks)""", "open high low close volume")
def stream_bars(spark, sf):
    d = rc.run_available(rc.stream_bars(tick_stream(spark, sf), "1 hour"), "bars")
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SS12", """WITH @ticks, lim AS (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi, max(event_time) AS newest FROM ticks), a AS (SELECT t.*, newest, time_bucket(INTERVAL 1 HOUR, event_time) AS ts, ((epoch_us(event_time) - lo) * 4) // (hi - lo + 1) + CASE WHEN trade_id % 50 = 0 THEN 1 ELSE 0 END AS arrival FROM ticks t CROSS JOIN lim),
m AS (SELECT arrival, max(max(event_time)) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS shut FROM a GROUP BY arrival), c AS (SELECT a.*, CASE WHEN ts + INTERVAL 1 HOUR <= shut THEN 'late' WHEN ts + INTERVAL 1 HOUR <= newest - INTERVAL 10 MINUTE THEN 'bar' ELSE 'open' END AS kind FROM a JOIN m ON a.arrival = m.arrival)
SELECT kind, symbol, ts, arg_min(price, (event_time, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (event_time, trade_id)) AS close, sum(size) AS volume, count(*) AS n_trades FROM c GROUP BY 1, 2, 3""", "open high low close volume")
def stream_bars_with_late(spark, sf):
    # five arrivals: four stretches of the time line, every fiftieth tick one arrival after its stretch; the stream starts anew for each
    us = F.unix_micros("event_time")
    t = ticks(spark, sf).withColumn("event_time", F.col("event_time").cast("timestamp"))
    lim = t.agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    t = t.crossJoin(F.broadcast(lim))  # one-row side
    t = t.withColumn("arrival", F.expr("(unix_micros(event_time) - lo) * 4 div (hi - lo + 1)") + (F.col("trade_id") % 50 == 0).cast("long")).drop("lo", "hi")
    log = rc.BarLog(spark, width="1 hour")
    landed = f"{log.folder}/landed"
    shape = t.drop("arrival").schema
    for k in range(5):
        t.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(landed)
        log.run(spark.readStream.schema(shape).parquet(landed))
    late = rc.partial_bars(log.late(), "1 hour")
    names = ["symbol", "ts", "open", "high", "low", "close", "volume", "n_trades"]
    parts = [d.select(F.lit(kind).alias("kind"), *names) for kind, d in (("bar", log.bars()), ("open", log.open_bars()), ("late", late))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def prediction_tables(ev):
    t = F.col("ts").cast("timestamp")
    p = ev.select(F.col("event_id").alias("signal_id"), t.alias("ts"), (F.col("value") / 100).alias("confidence"))
    v = ev.filter("event_id % 6 <> 0").select(F.col("event_id").alias("signal_id"), F.timestamp_micros(F.unix_micros(t) + (F.col("event_id") % 90) * 1_000_000).alias("ts"), F.when(F.col("event_id") % 4 == 0, "veto").otherwise("pass").alias("decision"))
    return p, v


PAIRS = """p AS (SELECT event_id AS signal_id, ts FROM events), q AS (SELECT signal_id, ts, signal_id % 6 <> 0 AND signal_id % 90 <= 60 AS paired FROM p)"""


@query("SS4", f"""WITH {PAIRS} SELECT signal_id, CASE WHEN paired THEN 'paired' ELSE 'timeout' END AS outcome, CASE WHEN paired THEN CASE WHEN signal_id % 4 = 0 THEN 'veto' ELSE 'pass' END END AS decision FROM q""")
def paired_predictions(spark, sf):
    p, v = prediction_tables(table(spark, sf, "events"))
    return ex.pair_predictions(p.unionByName(p.filter("signal_id % 10 = 0")), v).select("signal_id", "outcome", "decision")


@query("SS4", f"""WITH {PAIRS} SELECT signal_id, 'paired' AS outcome, CASE WHEN signal_id % 4 = 0 THEN 'veto' ELSE 'pass' END AS decision FROM q WHERE paired""")
def stream_paired_predictions(spark, sf):
    p, v = prediction_tables(rc.source(spark, f"{sf}/events.parquet"))
    d = rc.run_available(ex.pair_predictions(p, v), "pairs")
    # timeouts appear as the watermark passes them; the paired rows are complete at the end of the input
    return d.filter("outcome = 'paired'").select("signal_id", "outcome", "decision")


@query("SS5", """WITH o AS (SELECT user_id % 3 AS book, ts, event_id FROM events) SELECT event_id, count(*) OVER (PARTITION BY book ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) - 1 AS recent_orders FROM o""")
def recent_orders(spark, sf):
    o = table(spark, sf, "events").select((F.col("user_id") % 3).alias("book"), "ts", "event_id")
    return ex.recent_orders(o, seconds=600).select("event_id", "recent_orders")


@query("SS6 SS10", """WITH t AS (SELECT o_orderkey AS k, o_orderkey % 50 = 0 AS killed, o_custkey % 400 AS gap, o_orderkey % 2 = 0 AS cr, 100000.0 + o_orderkey % 7 * 1000 AS eq, (o_custkey % 9 - 6) * 500.0 AS pnl, o_totalprice AS gross, o_totalprice / 10 AS sym, o_orderkey % 8 AS rec, CASE o_orderkey % 4 WHEN 0 THEN 'veto' ELSE 'pass' END AS dec,
 (o_custkey % 11) / 10.0 AS conf, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS dir FROM orders),
g AS (SELECT *, CASE WHEN killed THEN 'kill_flag' WHEN gap > CASE WHEN cr THEN 200 ELSE 350 END THEN 'feed_freshness' WHEN CASE WHEN pnl < 0 THEN -pnl / eq ELSE 0 END > 0.02 OR (110000 - eq) / 110000 > 0.08 THEN 'drawdown' WHEN gross >= eq * 3 OR sym >= eq * 0.25 THEN 'exposure' WHEN rec >= 6 THEN 'rate_limit' WHEN dec <> 'pass' THEN 'decision' ELSE '' END AS reason FROM t)
SELECT k, reason, reason = '' AS allowed, reason IN ('kill_flag', 'feed_freshness', 'drawdown') AS kill_trigger, CASE WHEN dec = 'pass' AND dir <> 0 THEN sign(dir) * floor(abs(dir * least(eq * 0.05 * conf * (1 + CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN -0.2 ELSE CASE WHEN dir = 1 THEN 0.2 ELSE -0.2 END END), eq * 0.04) / 97.0) / 0.5) * 0.5 ELSE 0 END AS quantity FROM g""", "quantity")
def risk_gates(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf, "orders").select(k.alias("k"), (k % 50 == 0).alias("killed"), (c % 400).alias("gap_seconds"), (k % 2 == 0).alias("is_crypto"), (100000.0 + k % 7 * 1000).alias("account_equity"), F.lit(110000.0).alias("peak_equity"),
                                         ((c % 9 - 6) * 500.0).alias("daily_realized_pnl"), F.col("o_totalprice").alias("gross_exposure"), (F.col("o_totalprice") / 10).alias("symbol_notional"), (k % 8).alias("recent_orders"),
                                         F.when(k % 4 == 0, "veto").otherwise("pass").alias("decision"), ((c % 11) / 10.0).alias("confidence"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(-1).alias("direction"), F.lit(97.0).alias("mid_price"))
    d = ex.risk_gates(d, {"crypto_gap": 200, "equity_gap": 350, "daily_dd": 0.02, "cumulative_dd": 0.08, "gross": 3.0, "per_symbol": 0.25, "orders_per_minute": 6})
    t3 = F.when(k_mod(0), None).when(k_mod(1), "veto").otherwise("pass")
    d = d.withColumn("stance", ex.stance(F.col("direction"), t3, F.lit(1)))
    return ex.order_size(d, 0.05, 0.04, F.lit(0.5)).select("k", "reason", "allowed", "kill_trigger", "quantity")


def k_mod(m):
    return F.col("k") % 5 == m


def fill_table(ev):
    return ev.filter("value > 0").select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("fill_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("event_id") % 5 + 1).cast("double").alias("qty"), F.col("value").alias("price"))


BOOK = """f AS (SELECT user_id AS symbol, event_id AS fill_id, value AS price, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE * (event_id % 5 + 1) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value > 0),
r AS (SELECT symbol, fill_id, i, s AS q, price AS a, 0.0::DOUBLE AS pnl FROM f WHERE i = 1 UNION ALL SELECT f.symbol, f.fill_id, f.i, r.q + f.s, CASE WHEN r.q = 0 OR r.q * f.s > 0 THEN (r.q * r.a + f.s * f.price) / (r.q + f.s) WHEN r.q + f.s = 0 THEN 0 WHEN abs(f.s) > abs(r.q) THEN f.price ELSE r.a END,
 CASE WHEN r.q = 0 OR r.q * f.s > 0 THEN 0 ELSE sign(r.q) * least(abs(f.s), abs(r.q)) * (f.price - r.a) END FROM r JOIN f ON f.symbol = r.symbol AND f.i = r.i + 1)"""


@query("SS7", f"WITH RECURSIVE {BOOK} SELECT symbol, count(*) AS n_fills, sum(q) AS sum_position, sum(a * (1 + fill_id % 7)) AS sum_avg_price, sum(pnl * (1 + fill_id % 5)) AS sum_realized, min(q) AS min_position, max(q) AS max_position FROM r GROUP BY symbol", "sum_position sum_avg_price sum_realized min_position max_position", digits=5)
def position_book(spark, sf):
    b = ex.position_book(fill_table(table(spark, sf, "events")))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_fills"), F.sum("position").alias("sum_position"), F.sum(F.col("avg_price") * (1 + F.col("fill_id") % 7)).alias("sum_avg_price"),
                                   F.sum(F.col("realized_pnl") * (1 + F.col("fill_id") % 5)).alias("sum_realized"), F.min("position").alias("min_position"), F.max("position").alias("max_position"))


@query("SS7 SS8", f"WITH RECURSIVE {BOOK}, l AS (SELECT symbol, arg_max(q, i) AS position, arg_max(a, i) AS avg_price, sum(pnl) AS realized_pnl FROM r GROUP BY 1) SELECT *, abs(position) * CASE WHEN symbol % 2 = 0 THEN 50.0 ELSE avg_price END AS notional FROM l WHERE position <> 0", "position avg_price realized_pnl notional", digits=4)
def stream_position_book(spark, sf):
    book, _ = ex.stream_position_book(fill_table(rc.source(spark, f"{sf}/events.parquet")), rc.work_folder(spark, "book"))
    folder = rc.work_folder(spark, "snapshots")
    ex.write_snapshot(ex.latest_book(book), folder, "1")
    mid = table(spark, sf, "events").filter("user_id % 2 = 0").select(F.col("user_id").alias("symbol"), F.lit(50.0).alias("mid")).distinct()
    return ex.book_exposure(ex.restore_snapshot(spark, folder), mid)


@query("SS9 SS11 SRC22", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS audit_date, o_orderkey % 50 = 0 AS kill FROM orders), d AS (SELECT audit_date, count(*) AS n, count_if(kill) AS k, row_number() OVER (ORDER BY audit_date DESC) AS r FROM a GROUP BY 1)
SELECT count(*) AS audit_days, CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(CASE WHEN r <= 30 THEN k ELSE 0 END) AS BIGINT) AS recent_kill_triggers, 50.0::DOUBLE AS diff_bps, false AS within_limit FROM d""", "diff_bps")
def audit_window(spark, sf):
    from quantloom.sources.tables import append_audit, read_audit
    folder = rc.work_folder(spark, "audit")
    append_audit(table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderkey") % 50 == 0).alias("kill_trigger")).repartition(4), folder)
    c = ex.audit_counters(read_audit(spark, folder, "ts TIMESTAMP, kill_trigger BOOLEAN"), 30)
    return ex.reconcile(c.withColumns({"book_equity": F.lit(100_500.0), "external_equity": F.lit(100_000.0)})).drop("book_equity", "external_equity")
