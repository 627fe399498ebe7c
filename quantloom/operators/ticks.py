"""Trade, quote and depth features.  Row windows go through :func:`blocked`, see there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import div, require_columns
from quantloom.operators.blocks import BLOCK_ROWS, blocked


def quote_features(quotes: DataFrame, horizons: Sequence[int] = (1, 5, 15, 60, 300), windows: Sequence[int] = (10, 50, 200),
                   ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """L1 features and taker labels: mid, spread, imbalance, microprice, rolling volatility, event counts."""
    require_columns(quotes, ["symbol", "event_time", "best_bid", "best_ask", "best_bid_size", "best_ask_size"])
    if any(n <= 0 for n in (*horizons, *windows)):
        raise ValueError("horizons and windows must be positive")

    def build(d: DataFrame, over) -> DataFrame:
        d = d.withColumns({"mid_price": (F.col("best_bid") + F.col("best_ask")) / 2.0, "spread": F.col("best_ask") - F.col("best_bid"),
                           "top_size": F.col("best_bid_size") + F.col("best_ask_size")})
        d = d.withColumns({
            "l1_imbalance": F.when(F.col("top_size") > 0, div(F.col("best_bid_size") - F.col("best_ask_size"), "top_size")),
            "microprice": F.when(F.col("top_size") > 0, div(F.col("best_ask") * F.col("best_bid_size") + F.col("best_bid") * F.col("best_ask_size"), "top_size")),
            "relative_spread": div("spread", "mid_price"), "mid_return_1": div("mid_price", F.lag("mid_price", 1).over(over())) - 1.0})
        out = {"microprice_deviation": div("microprice", "mid_price") - 1.0}
        for n in sorted(set(windows)):
            f = over(-(n - 1))
            out |= {f"realized_vol_{n}": F.when(F.count("mid_return_1").over(f) >= 2, F.stddev_samp("mid_return_1").over(f)),
                    f"event_count_{n}": F.least(F.col("_idx") + 1, F.lit(n))}
        for h in sorted(set(horizons)):
            mid, bid, ask = (F.lead(c, h).over(over()) for c in ("mid_price", "best_bid", "best_ask"))
            out |= {f"future_mid_return_{h}": div(mid, "mid_price") - 1.0, f"future_best_bid_{h}": bid, f"future_best_ask_{h}": ask,
                    f"future_taker_long_return_{h}": div(bid, "best_ask") - 1.0, f"future_taker_short_return_{h}": div("best_bid", ask) - 1.0,
                    f"mid_direction_up_{h}": (mid > F.col("mid_price")).cast("byte")}
        return d.withColumns(out)

    # the return of the first row of a frame reads one row further back
    return blocked(quotes, build, back=max(windows, default=1) + 1, ahead=max(horizons, default=0), ties=ties, block_rows=block_rows).drop("_idx")


def trade_flow_features(trades: DataFrame, horizons: Sequence[int] = (1, 5, 15, 60), windows: Sequence[int] = (10, 50, 200),
                        half_spread_bps: float = 1.0, ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Causal order-flow features, forward labels and a modelled constant-spread quote."""
    require_columns(trades, ["symbol", "event_time", "price", "size", "aggressor_sign"])
    hs = half_spread_bps * 1e-4

    def build(d: DataFrame, over) -> DataFrame:
        d = d.withColumns({"signed_size": F.col("size") * F.col("aggressor_sign"), "price_return_1": div("price", F.lag("price", 1).over(over())) - 1.0})
        out = {}
        for n in sorted(set(windows)):
            f = over(-(n - 1))
            vol = F.sum("size").over(f)
            out |= {f"ofi_{n}": F.when(vol > 0, div(F.sum("signed_size").over(f), vol)), f"ret_{n}": div("price", F.lag("price", n).over(over())) - 1.0,
                    f"realized_vol_{n}": F.when(F.count("price_return_1").over(f) >= 2, F.stddev_samp("price_return_1").over(f)),
                    f"signed_count_imb_{n}": F.avg("aggressor_sign").over(f)}
        out |= {"best_bid": F.col("price") * (1 - hs), "best_ask": F.col("price") * (1 + hs), "relative_spread": F.lit(2 * hs),
                "best_bid_size": F.lit(1.0), "best_ask_size": F.lit(1.0)}
        for h in sorted(set(horizons)):
            p = F.lead("price", h).over(over())
            out |= {f"future_mid_return_{h}": div(p, "price") - 1.0, f"future_best_bid_{h}": p * (1 - hs), f"future_best_ask_{h}": p * (1 + hs)}
        return d.withColumns(out)

    return blocked(trades, build, back=max(windows, default=1) + 1, ahead=max(horizons, default=0), ties=ties, block_rows=block_rows).drop("_idx")


def depth_features(books: DataFrame, horizons: Sequence[int] = (1, 5, 15, 60), depths: Sequence[int] = (1, 5, 10, 20), time: str = "event_time",
                   ties: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """L2 features from ``bids``/``asks`` arrays of [price, qty]: touch, cumulative depth, imbalances, future prices.

    Snapshots with an empty side are dropped before the ordering, as their row does not count.
    """
    require_columns(books, ["symbol", "bids", "asks"])
    d = books.filter((F.size("bids") > 0) & (F.size("asks") > 0))
    level = lambda s, k: F.get(F.get(s, 0), k)
    d = d.withColumns({"best_bid": level("bids", 0), "best_bid_qty": level("bids", 1), "best_ask": level("asks", 0), "best_ask_qty": level("asks", 1)})
    total = F.col("best_bid_qty") + F.col("best_ask_qty")
    d = d.withColumns({"mid_price": (F.col("best_bid") + F.col("best_ask")) / 2.0, "spread": F.col("best_ask") - F.col("best_bid"),
                       "microprice_l1": div(F.col("best_ask") * F.col("best_bid_qty") + F.col("best_bid") * F.col("best_ask_qty"), total),
                       "imbalance_l1": div(F.col("best_bid_qty") - F.col("best_ask_qty"), total)})
    d = d.withColumn("relative_spread", div("spread", "mid_price"))
    cum = lambda s, n: F.aggregate(F.slice(s, 1, n), F.lit(0.0), lambda a, v: a + v[1])
    for n in depths:
        d = d.withColumns({f"bid_depth_{n}": cum("bids", n), f"ask_depth_{n}": cum("asks", n)})
        d = d.withColumn(f"imbalance_depth_{n}", div(F.col(f"bid_depth_{n}") - F.col(f"ask_depth_{n}"), F.col(f"bid_depth_{n}") + F.col(f"ask_depth_{n}")))

    def build(x: DataFrame, over) -> DataFrame:
        out = {}
        for h in sorted(set(horizons)):
            mid = F.lead("mid_price", h).over(over())
            out |= {f"future_mid_return_{h}": div(mid, "mid_price") - 1.0, f"mid_direction_up_{h}": (mid > F.col("mid_price")).cast("byte"),
                    f"future_mid_price_{h}": mid, f"future_best_bid_{h}": F.lead("best_bid", h).over(over()), f"future_best_ask_{h}": F.lead("best_ask", h).over(over())}
        return x.withColumns(out)

    return blocked(d.drop("bids", "asks"), build, back=0, ahead=max(horizons), time=time, ties=ties, block_rows=block_rows).drop("_idx")


def minute_bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Bars from ticks by event-time window (combinable aggregates; works on batch and stream)."""
    # (time, id) as one fixed-width number: the aggregation stays hash-based
    order = (F.unix_micros("event_time").cast("decimal(18,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)") + F.col("trade_id").cast("decimal(19,0)")).cast("decimal(38,0)")
    return (ticks.groupBy("symbol", F.window("event_time", width).alias("w"))
            .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
                 F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
            .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_trades"))
