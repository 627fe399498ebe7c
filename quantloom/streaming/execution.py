"""Pairing of predictions and verdicts, risk gates, sizing and the position book."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.operators.blocks import BLOCK_ROWS, numbered
from quantloom.session import stored

PAIR_SECONDS = 60


def pair_predictions(predictions: DataFrame, verdicts: DataFrame, within: int = PAIR_SECONDS, lateness: str = "30 seconds") -> DataFrame:
    """Prediction with its verdict inside the window, else a timeout row.

    Works on streams (a left outer join with watermarks on both sides; the timeout row appears once the
    watermark has passed) and, without watermarks, on batches.  Repeated prediction ids are ignored.
    """
    p = predictions.select(F.col("signal_id"), F.col("ts").alias("pred_ts"), *[c for c in predictions.columns if c not in ("signal_id", "ts")])
    v = verdicts.select(F.col("signal_id").alias("verdict_id"), F.col("ts").alias("verdict_ts"), "decision")
    if predictions.isStreaming:
        p = p.withWatermark("pred_ts", lateness).dropDuplicatesWithinWatermark(["signal_id"])
        v = v.withWatermark("verdict_ts", lateness)
    else:
        from quantloom.sources.market import keep_last
        p = keep_last(p, ["signal_id"], ["pred_ts"], first=True)
    on = (F.col("signal_id") == F.col("verdict_id")) & (F.col("verdict_ts") >= F.col("pred_ts")) & (F.col("verdict_ts") <= F.col("pred_ts") + F.expr(f"INTERVAL {within} SECONDS"))
    d = p.join(v, on, "left_outer")
    return d.withColumn("outcome", F.when(F.col("verdict_id").isNull(), "timeout").otherwise("paired")).drop("verdict_id")


# Gate names in their fixed order and whether a failure also trips the kill switch.
GATES = (("kill_flag", True), ("feed_freshness", True), ("drawdown", True), ("exposure", False), ("rate_limit", False), ("decision", False))


def risk_gates(tickets: DataFrame, limits: dict[str, float]) -> DataFrame:
    """First failing gate names the reason.

    Columns: killed, gap_seconds, is_crypto, account_equity, peak_equity, daily_realized_pnl, gross_exposure,
    symbol_notional, recent_orders, decision.
    """
    eq = F.col("account_equity")
    daily = F.when(F.col("daily_realized_pnl") < 0, div(-F.col("daily_realized_pnl"), eq)).otherwise(0.0)
    cum = F.when(F.col("peak_equity") > 0, div(F.col("peak_equity") - eq, "peak_equity")).otherwise(0.0)
    fresh = F.col("gap_seconds") <= F.when(F.col("is_crypto"), limits["crypto_gap"]).otherwise(limits["equity_gap"])
    ok = {"kill_flag": ~F.col("killed"), "feed_freshness": F.coalesce(fresh, F.lit(False)), "drawdown": (eq > 0) & (daily <= limits["daily_dd"]) & (cum <= limits["cumulative_dd"]),
          "exposure": (eq > 0) & (F.col("gross_exposure") < eq * limits["gross"]) & (F.coalesce("symbol_notional", F.lit(0.0)) < eq * limits["per_symbol"]),
          "rate_limit": F.col("recent_orders") < limits["orders_per_minute"], "decision": F.col("decision") == "pass"}
    reason = F.coalesce(*[F.when(~F.coalesce(ok[g], F.lit(False)), F.lit(g)) for g, _ in GATES], F.lit(""))
    d = tickets.withColumn("reason", reason)
    return d.withColumn("allowed", F.col("reason") == "").withColumn("kill_trigger", F.col("reason").isin(*[g for g, k in GATES if k]))


def stance(primary_direction: Column, tier3_decision: Column, tier3_direction: Column, pct: float = 0.20) -> Column:
    return (F.when(tier3_decision.isNull() | (tier3_decision == "insufficient_evidence"), 0.0).when(tier3_decision == "veto", -pct)
            .when(tier3_direction == primary_direction, pct).otherwise(-pct))


def order_size(tickets: DataFrame, base_pct: float, per_symbol_pct: float, lot: Column | None = None) -> DataFrame:
    """Confidence-scaled quantity: equity × base × confidence × (1 ± stance), capped, floored to the lot toward zero."""
    lot_size = F.lit(0.0) if lot is None else lot
    live = (F.col("decision") == "pass") & (F.col("direction") != 0) & (F.col("mid_price") > 0) & (F.col("account_equity") > 0)
    target = F.col("account_equity") * base_pct * F.col("confidence") * (1.0 + F.col("stance"))
    target = F.least(target, F.col("account_equity") * per_symbol_pct)
    qty = F.col("direction") * target / F.col("mid_price")
    lots = F.when(lot_size > 0, F.signum(qty) * F.floor(F.abs(qty) / lot_size) * lot_size).otherwise(qty)
    return tickets.withColumn("quantity", F.when(live, lots).otherwise(0.0))


def recent_orders(orders: DataFrame, seconds: int = 60, book: str = "book", bucket_seconds: int = 3600) -> DataFrame:
    """Orders of the book in the last ``seconds``; each time bucket also sees the end of the one before it."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    d = orders.withColumn("_t", t).withColumn("_home", F.floor(t / (bucket_seconds * 1_000_000)))
    spill = F.when(t % (bucket_seconds * 1_000_000) >= (bucket_seconds - seconds) * 1_000_000, F.col("_home") + 1)
    d = d.withColumn("_b", F.explode(F.array_compact(F.array("_home", spill))))
    w = W.partitionBy(book, "_b").orderBy("_t").rangeBetween(-seconds * 1_000_000, 0)
    return d.withColumn("recent_orders", F.count(F.lit(1)).over(w) - 1).filter("_b = _home").drop("_t", "_home", "_b")


# ---------------------------------------------------------------- position book

FOLD_ROWS = 1024  # rows folded in one array; blocks of a symbol are folded again


def composed(rows: str, scale: str, shift: str) -> Column:
    """The maps c -> scale c + shift of an ordered array as one."""
    one = F.struct(F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"))
    return F.aggregate(rows, one, lambda st, x: F.struct((x[scale] * st["scale"]).alias("scale"), (x[scale] * st["shift"] + x[shift]).alias("shift")))


def first_bases(maps: DataFrame, opening: DataFrame | None, fold_rows: int) -> DataFrame:
    """(symbol, _f, _first): the cost basis before each block, from the blocks' maps (symbol, _f, scale, shift)."""
    groups = maps.groupBy("symbol", F.floor(F.col("_f") / fold_rows).alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_f", "scale", "shift"))).alias("_ms"))
    if (maps.agg(F.max("_f")).first()[0] or 0) >= fold_rows:
        up = stored(groups.select("symbol", F.col("_g").alias("_f"), composed("_ms", "scale", "shift").alias("_m")).select("symbol", "_f", "_m.scale", "_m.shift"))
        groups = groups.join(first_bases(up, opening, fold_rows).select("symbol", F.col("_f").alias("_g"), F.col("_first").alias("_c")), ["symbol", "_g"])
    elif opening is not None:
        groups = groups.join(opening.select("symbol", F.col("_c0").alias("_c")), "symbol", "left")
    else:
        groups = groups.withColumn("_c", F.lit(0.0))
    begin = F.struct(F.coalesce("_c", F.lit(0.0)).alias("c"), F.array().cast("array<struct<_f:bigint,_first:double>>").alias("out"))
    carried = F.aggregate("_ms", begin, lambda st, m: F.struct((m["scale"] * st["c"] + m["shift"]).alias("c"), F.concat(st["out"], F.array(F.struct(m["_f"].alias("_f"), st["c"].alias("_first")))).alias("out")))
    return stored(groups.select("symbol", F.explode(carried["out"]).alias("_o")).select("symbol", "_o._f", "_o._first"))


def position_book(fills: DataFrame, ties: Sequence[str] = ("fill_id",), block_rows: int = BLOCK_ROWS, opening: DataFrame | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Quantity, average price and realised P&L after every fill; ``opening`` (symbol, position, avg_price) is the book before the first one.

    The quantity is a running sum.  The cost basis follows c_t = a_t c_{t-1} + b_t with known a and b: an opening or flipping fill sets it,
    an increase adds its cost, a reduction scales by q_t / q_{t-1}.  Such maps compose, so each block of rows is folded to one
    map, level by level until a symbol has one, the first basis of each block comes back down the levels, and the blocks are folded again from there.  A
    book that never goes flat is cut like any other, and no task holds more than ``fold_rows`` rows or maps of a symbol at once.
    """
    s = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    d = numbered(fills.withColumn("_s", s), "ts", ties).withColumn("_blk", F.floor(F.col("_idx") / block_rows))

    def running(x: DataFrame, value: str, name: str) -> DataFrame:
        inside = W.partitionBy("symbol", "_blk").orderBy("_idx").rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy("symbol").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
        tot = x.groupBy("symbol", "_blk").agg(F.sum(value).alias("_tot")).select("symbol", "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
        return x.join(tot, ["symbol", "_blk"]).withColumn(name, F.sum(value).over(inside) + F.col("_off")).drop("_off")

    d = running(d, "_s", "position")
    if opening is not None:
        opening = stored(opening.select("symbol", F.col("position").alias("_q0"), (F.col("position") * F.col("avg_price")).alias("_c0")))
        d = d.join(opening.select("symbol", "_q0"), "symbol", "left").withColumn("position", F.col("position") + F.coalesce("_q0", F.lit(0.0))).drop("_q0")
    d = d.withColumn("_p", F.round(F.col("position") - F.col("_s"), 9)).withColumn("position", F.round("position", 9))
    flip = F.col("position") * F.col("_p") < 0
    start = (F.col("_p") == 0) | flip
    grow = F.signum("_p") == F.signum("_s")
    d = d.withColumns({"_a": F.when(start | (F.col("position") == 0), 0.0).when(grow, 1.0).otherwise(F.col("position") / F.col("_p")),
                       "_b": F.when(start, F.col("position") * F.col("price")).when(grow, F.col("_s") * F.col("price")).otherwise(0.0).cast("double")})

    rest = [c for c in d.columns if c not in ("symbol", "_idx")]
    d = d.withColumn("_f", F.floor(F.col("_idx") / fold_rows)).groupBy("symbol", "_f").agg(F.sort_array(F.collect_list(F.struct("_idx", *rest))).alias("_rows"))
    maps = stored(d.select("symbol", "_f", composed("_rows", "_a", "_b").alias("_m")).select("symbol", "_f", "_m.scale", "_m.shift"))
    firsts = first_bases(maps, opening, fold_rows)
    state = F.struct(F.col("_first").alias("c"), F.array().cast("array<struct<_before:double,_c:double>>").alias("out"))

    def step(st: Column, x: Column) -> Column:
        c = x["_a"] * st["c"] + x["_b"]
        return F.struct(c.alias("c"), F.concat(st["out"], F.array(F.struct(st["c"].alias("_before"), c.alias("_c")))).alias("out"))

    d = d.join(firsts, ["symbol", "_f"]).withColumn("_bases", F.aggregate("_rows", state, step)["out"])
    d = d.select("symbol", F.explode(F.arrays_zip("_rows", "_bases")).alias("_z")).select("symbol", "_z._rows.*", "_z._bases.*")
    d = d.withColumn("avg_price", F.when(F.col("position") == 0, 0.0).otherwise(F.col("_c") / F.col("position")))
    closing = F.least(F.abs("_s"), F.abs("_p"))
    opens = (F.col("_p") == 0) | grow
    gain = F.signum("_p") * closing * (F.col("price") - F.try_divide("_before", "_p"))
    return d.withColumn("realized_pnl", F.when(opens, 0.0).otherwise(gain)).drop("_s", "_idx", "_blk", "_p", "_a", "_b", "_before", "_c")


def stream_position_book(fills: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fold all available fills of a stream (time-ordered per symbol across batches) into a book under ``folder``: every fill with its book, and the newest book.

    Each micro-batch is a :func:`position_book` that opens with the book of the batch before, so a symbol that fills a batch is cut into blocks there as
    well.  Both tables are written per batch number: a batch that runs again overwrites its own rows, and a restart goes on from the last one.
    """
    spark = fills.sparkSession

    def fold(batch: DataFrame, epoch: int) -> None:
        opening = spark.read.parquet(f"{folder}/book/batch={epoch - 1}") if epoch else None
        book = stored(position_book(batch, block_rows=block_rows, opening=opening))
        book.select("symbol", "ts", "fill_id", "position", "avg_price", "realized_pnl").write.mode("overwrite").parquet(f"{folder}/fills/batch={epoch}")
        last = latest_book(book).select("symbol", "position", "avg_price")
        whole = last if opening is None else last.unionByName(opening.join(last.select("symbol"), "symbol", "left_anti"))
        whole.write.mode("overwrite").parquet(f"{folder}/book/batch={epoch}")

    fills.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.parquet(f"{folder}/book")
    newest = batches.join(F.broadcast(batches.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one-row side
    return spark.read.parquet(f"{folder}/fills").drop("batch"), newest


def book_exposure(latest: DataFrame, mid: DataFrame) -> DataFrame:
    """Notional per symbol at the mid price, or at the average price without one."""
    d = latest.join(mid.select("symbol", F.col("mid").alias("_m")), "symbol", "left")
    return d.filter("position <> 0").withColumn("notional", F.abs("position") * F.coalesce("_m", "avg_price")).drop("_m")


def latest_book(book: DataFrame, ties: Sequence[str] = ("fill_id",)) -> DataFrame:
    return book.groupBy("symbol").agg(F.max_by(F.struct("position", "avg_price"), F.struct("ts", *ties)).alias("b"), F.sum("realized_pnl").alias("realized_pnl")).select("symbol", "b.*", "realized_pnl")


def write_snapshot(book: DataFrame, folder: str, stamp: str) -> None:
    book.write.mode("overwrite").parquet(f"{folder}/snapshot={stamp}")


def restore_snapshot(spark, folder: str) -> DataFrame:
    """Positions of the newest snapshot."""
    d = spark.read.parquet(folder)
    top = d.agg(F.max("snapshot").alias("_s"))
    return d.join(F.broadcast(top), d["snapshot"] == top["_s"]).drop("_s", "snapshot")


def reconcile(equities: DataFrame, limit_bps: float = 10.0) -> DataFrame:
    """Book against external equity in basis points; a non-positive external equity is an infinite difference."""
    diff = F.when(F.col("external_equity") <= 0, F.lit(float("inf"))).otherwise(F.abs(F.col("book_equity") - F.col("external_equity")) / F.col("external_equity") * 1e4)
    return equities.withColumn("diff_bps", diff).withColumn("within_limit", F.col("diff_bps") <= limit_bps)


def audit_counters(audit: DataFrame, last_days: int) -> DataFrame:
    """Days with an audit and kill triggers in the newest ``last_days`` of them."""
    per = audit.groupBy("audit_date").agg(F.count_if(F.col("kill_trigger")).alias("kills"), F.count(F.lit(1)).alias("n"))
    r = per.withColumn("_r", F.row_number().over(W.orderBy(F.col("audit_date").desc())))  # one row per date
    return r.agg(F.count(F.lit(1)).alias("audit_days"), F.sum("n").alias("n_records"), F.sum(F.when(F.col("_r") <= last_days, F.col("kills")).otherwise(0)).alias("recent_kill_triggers"))
