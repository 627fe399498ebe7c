"""Streams against batches, late data, landed formats and text details."""

import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions.columns import ContractError
from quantloom.operators import joins as jn
from quantloom.operators import plugins as pl
from quantloom.operators import text as tx
from quantloom.operators import ticks as tk
from quantloom.sources import market as mk
from quantloom.sources import tables as tb
from quantloom.streaming import execution as ex
from quantloom.streaming import record as rc

RNG = np.random.default_rng(3)
T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def file_stream(spark, tmp_path, name, batches, schema):
    """One file per batch, read one per trigger."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        f = folder / f"{i:03d}.json"
        f.write_text("\n".join(json.dumps(r, default=lambda v: v.isoformat(sep=" ")) for r in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # the source reads by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_pairing_with_timeouts_and_duplicates(spark, tmp_path):
    preds = [[{"signal_id": "a", "ts": at(0)}, {"signal_id": "b", "ts": at(1)}, {"signal_id": "a", "ts": at(2)}], [{"signal_id": "z", "ts": at(4000)}], [{"signal_id": "y", "ts": at(8000)}]]
    verd = [[{"signal_id": "a", "ts": at(30), "decision": "pass"}], [{"signal_id": "b", "ts": at(500), "decision": "veto"}], [{"signal_id": "q", "ts": at(8000), "decision": "pass"}]]
    p = file_stream(spark, tmp_path, "p", preds, "signal_id string, ts timestamp")
    v = file_stream(spark, tmp_path, "v", verd, "signal_id string, ts timestamp, decision string")
    got = {r.signal_id: r.outcome for r in rc.run_available(ex.pair_predictions(p, v), "pairs").collect()}
    assert got["a"] == "paired" and got["b"] == "timeout"


def test_late_ticks_do_not_reopen_a_bar(spark, tmp_path):
    row = lambda i, s, p: {"symbol": 1, "event_time": at(s), "trade_id": i, "price": p, "size": 1.0}
    ticks = [[row(1, 0, 10.0), row(2, 30, 11.0)], [row(3, 3600, 12.0)], [row(7, 3700, 12.0)], [row(4, 10, 99.0), row(5, 7200, 13.0)], [row(6, 9000, 14.0)]]
    s = file_stream(spark, tmp_path, "t", ticks, "symbol long, event_time timestamp, trade_id long, price double, size double")
    bars = rc.run_available(rc.stream_bars(s), "bars").orderBy("ts").collect()
    assert [(b.open, b.close, b.high, b.n_trades) for b in bars][0] == (10.0, 11.0, 11.0, 2)


def test_every_tick_is_in_a_bar_or_late(spark, tmp_path):
    row = lambda i, s, p, sym=1: {"symbol": sym, "event_time": None if s is None else at(s), "trade_id": i, "price": p, "size": 1.0}
    schema = "symbol long, event_time timestamp, trade_id long, price double, size double"
    batches = [[row(1, 0, 10.0), row(2, 30, 11.0)], [row(3, 20, 12.0), row(4, 3600, 13.0), row(5, None, 1.0)], [row(6, 10, 99.0), row(7, 3605, 14.0), row(8, 3001, 15.0), row(9, 3601, 9.0, None)], [row(10, 9000, 16.0)]]
    log = rc.BarLog(spark, f"{tmp_path}/log")
    stream = file_stream(spark, tmp_path, "t", batches[:3], schema)
    log.run(stream)
    again = rc.BarLog(spark, log.folder)  # a fresh process goes on from the folder
    f = tmp_path / "t" / "003.json"
    f.write_text("\n".join(json.dumps(r, default=lambda v: v.isoformat(sep=" ")) for r in batches[3]))
    again.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/t"))
    bars = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.n_trades) for r in log.bars().collect()}
    # the tick of second 20 comes before any mark; that of second 3001 ends after 3600 - 600 seconds and is on time
    assert bars == {(1, at(0)): (10.0, 12.0, 10.0, 11.0, 3), (1, at(3600)): (13.0, 14.0, 13.0, 14.0, 2), (1, at(3000)): (15.0, 15.0, 15.0, 15.0, 1), (None, at(3600)): (9.0, 9.0, 9.0, 9.0, 1)}
    assert {(r.trade_id, r.late_reason) for r in log.late().collect()} == {(5, "no_time"), (6, "closed")}
    assert [(r.ts, r.n_trades) for r in log.open_bars().collect()] == [(at(9000), 1)]
    # a micro-batch that runs again writes the same tables
    log._micro_batch(spark.createDataFrame([(10, at(9000), 10, 16.0, 1.0)], schema).withColumn("symbol", F.lit(1).cast("long")), 3)
    assert log.bars().count() == 4 and log.late().count() == 2


def test_book_that_never_goes_flat(spark):
    n = 3000
    pdf = pd.DataFrame({"symbol": 1, "ts": [at(i) for i in range(n + 1)], "fill_id": np.arange(n + 1), "side": ["buy"] + ["sell", "buy"] * (n // 2), "qty": [2.0] + [1.0] * n, "price": 100 + np.arange(n + 1) % 7 * 1.5})
    book = ex.position_book(spark.createDataFrame(pdf), block_rows=64).toPandas().sort_values("fill_id")
    q, a, want = 0.0, 0.0, []
    for r in pdf.itertuples():
        s, pnl = (r.qty if r.side == "buy" else -r.qty), 0.0
        if q == 0 or q * s > 0:
            a = (q * a + s * r.price) / (q + s)
        else:
            pnl = min(abs(s), abs(q)) * (r.price - a)
        q += s
        want.append((q, a, pnl))
    np.testing.assert_allclose(book[["position", "avg_price", "realized_pnl"]].to_numpy(), np.array(want), atol=1e-7)


def test_position_book_batch_stream_and_loop(spark, tmp_path):
    n = 300
    pdf = pd.DataFrame({"symbol": np.where(RNG.random(n) < 0.8, 1, 2), "ts": [at(int(x)) for x in np.sort(RNG.integers(0, 9000, n))], "fill_id": np.arange(n), "side": RNG.choice(["buy", "sell"], n),
                        "qty": RNG.integers(1, 5, n).astype(float), "price": RNG.uniform(90, 110, n).round(2)})
    fills = spark.createDataFrame(pdf)
    batch = ex.position_book(fills, block_rows=16).toPandas().sort_values("fill_id").reset_index(drop=True)
    want, book = [], {}
    for r in pdf.itertuples():
        st = book.setdefault(r.symbol, [0.0, 0.0])
        s, pnl = (r.qty if r.side == "buy" else -r.qty), 0.0
        q, a = st
        if q == 0 or q * s > 0:
            a = (q * a + s * r.price) / (q + s)
        else:
            pnl = np.sign(q) * min(abs(s), abs(q)) * (r.price - a)
            a = 0.0 if q + s == 0 else (r.price if abs(s) > abs(q) else a)
        st[:] = [q + s, a]
        want.append((q + s, a, pnl))
    np.testing.assert_allclose(batch[["position", "avg_price", "realized_pnl"]].to_numpy(), np.array(want), atol=1e-6)
    rows = pdf.to_dict("records")
    s = file_stream(spark, tmp_path, "f", [rows[:100], rows[100:200], rows[200:]], "symbol long, ts timestamp, fill_id long, side string, qty double, price double")
    folder = str(tmp_path / "book")
    done, newest = ex.stream_position_book(s, folder, block_rows=16)
    stream = done.toPandas().sort_values("fill_id").reset_index(drop=True)
    np.testing.assert_allclose(stream[["position", "avg_price", "realized_pnl"]].to_numpy(), np.array(want), atol=1e-6)
    assert {r.symbol: (r.position, round(r.avg_price, 6)) for r in newest.collect()} == {k: (q, round(a, 6)) for k, (q, a) in book.items()}


def test_fold_by_levels_and_opening_book(spark):
    """Blocks of three rows or maps, so that one symbol needs five levels; a second part opens with the book of the first."""
    n = 400
    rows = [(1, at(i), i, "buy" if RNG.random() < 0.6 else "sell", float(RNG.integers(1, 5)), float(RNG.integers(90, 110))) for i in range(n)] + [(2, at(5), n, "sell", 3.0, 50.0)]
    fills = spark.createDataFrame(rows, "symbol long, ts timestamp, fill_id long, side string, qty double, price double")
    columns = ["fill_id", "position", "avg_price", "realized_pnl"]
    whole = ex.position_book(fills).select(columns).orderBy("fill_id").toPandas().to_numpy()
    np.testing.assert_allclose(ex.position_book(fills, block_rows=50, fold_rows=3).select(columns).orderBy("fill_id").toPandas().to_numpy(), whole, atol=1e-7)
    first = ex.position_book(fills.filter("fill_id < 200"))
    second = ex.position_book(fills.filter("fill_id >= 200"), opening=ex.latest_book(first), fold_rows=7)
    np.testing.assert_allclose(first.unionByName(second).select(columns).orderBy("fill_id").toPandas().to_numpy(), whole, atol=1e-7)


def test_trades_share_a_millisecond(spark):
    raw = spark.createDataFrame([(3, 10.0, 1.0, 1000, "False"), (1, 10.0, 1.0, 1000, "True"), (2, 10.0, 2.0, 1000, "false"), (4, 10.0, 1.0, 2000, "True"), (5, 0.0, 1.0, 2000, "True")],
                                "agg_trade_id long, price double, quantity double, transact_time long, is_buyer_maker string")
    r = mk.normalise_trades(raw, "X").orderBy("event_time").collect()
    assert [x.aggressor_sign for x in r] == [-1.0, 1.0, 1.0, -1.0] and len({x.event_time for x in r}) == 4


def test_epoch_units_and_late_settlements(spark):
    k = spark.createDataFrame([(1704067200000, 1.0), (1704096000000000, 2.0)], "open_time long, close double").selectExpr("*", "close AS open", "close AS high", "close AS low")
    bars = mk.normalise_klines(k, "X")
    assert {str(r.ts) for r in bars.collect()} == {"2024-01-01 00:00:00", "2024-01-01 08:00:00"}
    f = mk.normalise_funding(spark.createDataFrame([(1704067200001, 8, 0.0001), (1704096000002, 8, 0.0002), (1704096000002, 8, 0.0001)], "calc_time long, funding_interval_hours int, last_funding_rate double"), "X")
    assert jn.carry_panel_hourly(f, bars, bars).count() == 2


def test_forward_returns_missing_bar(spark):
    bars = spark.createDataFrame([("A", at(60 * i), 100.0 + 0.5 * (i > 0)) for i in range(3)], "symbol string, ts timestamp, close double")
    req = spark.createDataFrame([("A", at(0), 2), ("A", at(0), 9)], "symbol string, fill_ts timestamp, horizon_minutes int")
    r = jn.forward_returns(req, bars).orderBy("horizon_minutes").collect()
    assert (r[0].realized_return, r[0].realized_direction) == (pytest.approx(0.005), 1) and (r[1].realized_return, r[1].realized_direction) == (None, 0)


def test_depth_update_and_features(spark):
    msgs = [{"s": "X", "E": 1000 * i, "u": i, "b": [[str(99 + i), "2"], [str(98 + i), "3"]], "a": [[str(101 + i), "1"], ["bad", "3"]] if i < 3 else []} for i in range(4)]
    d = mk.parse_depth_update(spark.createDataFrame([(json.dumps(m),) for m in msgs], "value string"))
    f = tk.depth_features(d, horizons=(1,), depths=(1, 2)).orderBy("update_id").collect()
    assert [x.mid_price for x in f] == [100.0, 101.0, 102.0] and [x.bid_depth_2 for x in f] == [5.0] * 3 and [x.ask_depth_2 for x in f] == [1.0] * 3
    assert f[0].future_mid_return_1 == pytest.approx(0.01) and f[2].future_mid_return_1 is None


def test_artifact_must_match_its_manifest(spark, tmp_path):
    path = str(tmp_path / "a")
    tb.write_shards(spark.range(10), path)
    good = tb.file_hashes(spark, path).select("path", "sha256")
    assert tb.verified_read(spark, path, good).count() == 10
    with pytest.raises(ContractError):
        tb.verified_read(spark, path, good.withColumn("sha256", F.lit("0")))


def test_artifact_with_a_lost_shard_is_refused(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(100).repartition(5).write.parquet(path)
    good = tb.file_hashes(spark, path).select("path", "sha256").collect()
    manifest = spark.createDataFrame(good, "path string, sha256 string")
    assert tb.verified_read(spark, path, manifest).count() == 100
    lost = next(f for f in (tmp_path / "a").iterdir() if f.name.endswith(".parquet"))
    lost.rename(tmp_path / "kept-elsewhere")
    with pytest.raises(ContractError):
        tb.verified_read(spark, path, manifest)


def test_fingerprint_ignores_order(spark):
    d = spark.range(100).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a, b = (tb.corpus_fingerprint(x, "k", "h", 16).first().sha256 for x in (d, d.orderBy(F.col("k").desc()).repartition(7)))
    assert a == b != tb.corpus_fingerprint(d.filter("k < 99"), "k", "h", 16).first().sha256


def test_canonical_fields():
    assert mk.resolve_fields(["Date", "OPEN", "adj_close", "Close", "Ticker"]) == {"timestamp": "Date", "open": "OPEN", "close": "Close", "symbol": "Ticker"}


def test_chunks_cover_the_end_once(spark):
    d = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in (5, 9, 10, 17, 18)], "doc_id int, text string")
    got = {}
    for r in tx.chunks(d, size=10, overlap=2, least=6).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.n_words))
    assert {k: sorted(v) for k, v in got.items()} == {9: [(0, 9)], 10: [(0, 10)], 17: [(0, 10), (1, 9)], 18: [(0, 10), (1, 10)]}


def test_sentences_keep_decimals(spark):
    d = spark.createDataFrame([("Sales rose 12.5 percent. It's up! Really?",), ("",), ("no end",)], "text string")
    r = [x for x in tx.section_features(d).collect()]
    assert [x.s_sentence_count for x in r] == [3.0, 0.0, 1.0] and r[0].s_word_count == 6.0


def test_citation_property(spark):
    corpus = spark.createDataFrame([(f"c{i}",) for i in range(50)], "id string")
    rows = [(f"sig-{i:05d}", str(RNG.choice(["pass", "veto"])), [f"c{int(x)}" for x in RNG.integers(0, 90, RNG.integers(0, 4))]) for i in range(300)]
    out = tx.resolve_citations(spark.createDataFrame(rows, "signal_id string, decision string, cited_paper_chunk_ids array<string>"), corpus).collect()
    valid = {f"c{i}" for i in range(50)}
    assert len(out) == 300 and all(set(r.cited_paper_chunk_ids) <= valid and (r.decision != "pass" or r.cited_paper_chunk_ids) for r in out)


def test_plugin_registry_checks_roles():
    with pytest.raises(TypeError):
        pl.Registry().register("strategy", object())
