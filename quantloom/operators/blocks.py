"""Row windows over event tables whose per-symbol groups have no size bound.

A symbol may hold a third of all ticks, so a window partitioned by symbol alone would sort it in one
task.  ``blocked`` numbers the rows of a symbol from per-(symbol, time bucket) counts, cuts them into
blocks of a fixed number of rows and gives every block the neighbouring rows its frames reach into.
A row window over (symbol, block) then returns exactly what the window over the symbol would.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 17
BUCKET_SECONDS = 3600


def numbered(df: DataFrame, time: str = "event_time", ties: Sequence[str] = (), key: str = "symbol",
             bucket_seconds: int = BUCKET_SECONDS, name: str = "_idx") -> DataFrame:
    """0-based position of each row in its symbol's time order, without sorting a symbol in one task."""
    d = df.withColumn("_bucket", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / bucket_seconds))
    d = d.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_bucket").orderBy(time, *ties)))
    sizes = d.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return d.join(offsets, [key, "_bucket"]).withColumn(name, F.col("_rn") + F.col("_off") - 1).drop("_rn", "_off", "_bucket")


def blocked(df: DataFrame, build: Callable[[DataFrame, Callable[..., WindowSpec]], DataFrame], *, back: int, ahead: int = 0,
            time: str = "event_time", ties: Sequence[str] = (), key: str = "symbol", block_rows: int = BLOCK_ROWS,
            bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Apply ``build(frame, over)`` where ``over(lo, hi)`` is a row frame (``over()`` has no frame).

    ``back``/``ahead`` bound how many rows the frames and lags reach; they must not exceed the block.
    """
    size = max(block_rows, back, ahead, 1)
    d = numbered(df, time, ties, key, bucket_seconds)
    home = F.floor(F.col("_idx") / size)
    pos = F.col("_idx") % size
    copies = F.array_compact(F.array(
        home, F.when(pos >= size - back, home + 1) if back else F.lit(None).cast("long"),
        F.when((pos < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("long")))
    d = d.withColumn("_home", home).withColumn("_block", F.explode(copies))

    def over(lo: int | None = None, hi: int = 0) -> WindowSpec:
        w = W.partitionBy(key, "_block").orderBy("_idx")
        return w if lo is None else w.rowsBetween(lo, hi)

    return build(d, over).filter(F.col("_home") == F.col("_block")).drop("_home", "_block")
