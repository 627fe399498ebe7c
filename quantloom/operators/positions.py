"""Position transforms between a raw signal and a traded position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import by, clip, col, div
from quantloom.functions.rolling import rolling
from quantloom.operators.features import held

POSITION_CAP = 3.0


def position_mode(x: str | Column, mode: str) -> Column:
    if mode == "long_short":
        return col(x)
    if mode == "long_only":
        return clip(x, 0.0)
    raise ValueError(f"unknown position mode {mode!r}")


def vol_target(x: str | Column, vol: str | Column, target: float = 0.01) -> Column:
    """Scale to a target volatility, capped; 0 without a positive volatility."""
    return F.when(col(vol) > 0, clip(col(x) * (target / col(vol)), -POSITION_CAP, POSITION_CAP)).otherwise(0.0)


def minimum_holding(x: str | Column, n: int, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> Column:
    return col(x) if n <= 1 else held(x, n, key, time)


def delayed(x: str, n: int, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), fill: float = 0.0) -> Column:
    """Execution delay by n rows with a leading fill."""
    return F.col(x) if n <= 0 else F.lag(x, n, fill).over(by(key, time))


def threshold_side(score: str | Column, threshold: float, side: str = "both", min_abs_score: float = 0.0, min_edge: float = 0.0) -> Column:
    """Side of a score beyond the largest of threshold, minimum score and edge requirement."""
    t = max(threshold, min_abs_score, min_edge)
    s = F.when(col(score) > t, 1.0).when(col(score) < -t, -1.0).otherwise(0.0)
    if side == "both":
        return s
    if side not in ("long_only", "short_only"):
        raise ValueError("side must be both, long_only or short_only")
    return F.greatest(s, F.lit(0.0)) if side == "long_only" else F.least(s, F.lit(0.0))


def vol_filter(df: DataFrame, which: str, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",), short: int = 120, short_min: int = 60,
               long: int = 1440, long_min: int = 120) -> DataFrame:
    """Flag ``vol_ok``: volatility at most (low) or above (high) its own long mean; unknown is false."""
    d = df.withColumn("_r", div("close", F.lag("close").over(by(key, time))) - 1.0)
    d = rolling(d, {"_v": ("std", "_r", short)}, key, time, least=short_min)
    d = rolling(d, {"_m": ("avg", "_v", long)}, key, time, least=long_min)
    test = F.col("_v") <= F.col("_m") if which == "low" else F.col("_v") > F.col("_m")
    return d.withColumn("vol_ok", F.coalesce(test, F.lit(False))).drop("_r", "_v", "_m")


def cooldown(df: DataFrame, position: str, bars: int, key: Sequence[str] = ("symbol",), time: Sequence[str] = ("date",)) -> DataFrame:
    """At least ``bars`` rows between entries or flips.

    An entry depends on when the last one was accepted, so this is a true ordered fold.  The rows of a key pass
    through their task in time order and leave three numbers behind, so a task folds all its keys in one pass.
    """
    if bars <= 0:
        return df.withColumn("cooled", F.col(position))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, current, since = None, 0.0, bars
        for pdf in batches:
            if pdf.empty:
                continue
            fresh = np.zeros(len(pdf), dtype=bool)
            for k in key:
                v, none = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
                fresh[1:] |= np.where(none[1:] | none[:-1], none[1:] != none[:-1], v[1:] != v[:-1])
            ends = [tuple(None if pd.isna(v) else v for v in (pdf[k].iloc[i] for k in key)) for i in (0, -1)]
            fresh[0] = ends[0] != last
            last, out = ends[1], []
            for want, new in zip(pdf[position].to_numpy(dtype=float).tolist(), fresh.tolist()):
                if new:
                    current, since = 0.0, bars
                if want == 0.0:
                    current = 0.0
                elif want != current and since >= bars:
                    current, since = want, 0
                out.append(current)
                since += 1
            yield pdf.assign(cooled=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", cooled double"
    return df.repartition(*key).sortWithinPartitions(*key, *time).mapInPandas(fold, schema)


def equal_sleeves(df: DataFrame, weight: str, date: str = "date") -> DataFrame:
    """Split capital equally across the sleeves that are on."""
    on = df.groupBy(date).agg(F.sum((F.col(weight) > 0).cast("int")).alias("_on"))
    return df.join(F.broadcast(on), date).withColumn(weight, F.col(weight) / F.greatest("_on", F.lit(1))).drop("_on")


def to_book_panel(signals: DataFrame, bars: DataFrame, sectors: DataFrame, adv_window: int = 20) -> DataFrame:
    """Signal to back-test panel: lagged dollar ADV, as-of date one day earlier, default tier and tradability."""
    b = rolling(bars.withColumn("_dv", F.lag(F.col("close") * F.col("volume")).over(by())), {"adv_20d_dollar_lag1": ("avg", "_dv", adv_window)}).drop("_dv")
    d = b.join(signals.select("symbol", "date", "y_xs_pred"), ["symbol", "date"], "left").join(sectors.select("symbol", "sector"), "symbol", "left")
    return d.withColumns({"execution_date": F.col("date"), "feature_as_of_date": F.date_sub("date", 1), "sector": F.coalesce("sector", F.lit("unknown")),
                          "borrow_tier": F.lit("general"), "tradable": F.col("y_xs_pred").isNotNull() & F.col("adv_20d_dollar_lag1").isNotNull(),
                          "in_pit_universe": F.lit(True), "roll_spread_bps": F.lit(None).cast("double")}).drop("date")
