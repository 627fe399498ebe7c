"""Recording and replay of ticks, bars from ticks, and heartbeats on Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.ticks import minute_bars
from quantloom.session import is_local

TICK_LATENESS = "10 minutes"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder; a temporary one only on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the files that match the last part of ``path``, with the schema of the landed table."""
    folder, _, name = path.rpartition("/")
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def run_available(stream: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Process all available input to a parquet sink (append) and read it back."""
    spark = stream.sparkSession
    out = work_folder(spark, name)
    w = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    q = (w.partitionBy(*partition_by) if partition_by else w).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def run_updates(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input in update mode; every micro-batch is appended with its id, the newest row per key wins on read."""
    spark = stream.sparkSession
    out = work_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/data/epoch={epoch}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data").drop("epoch")


def with_recording_keys(ticks: DataFrame, venue: Column) -> DataFrame:
    """The partition columns of the tick archive: venue, symbol, date and hour."""
    t = F.col("event_time").cast("timestamp")
    return ticks.withColumns({"venue": venue, "date": F.to_date(t), "hour": F.hour(t)})


def record_ticks(ticks: DataFrame, venue: Column | None = None) -> DataFrame:
    """Write the stream to hourly partitions; the symbol stays a column, so many small names share a file and a large one is split over files."""
    keyed = with_recording_keys(ticks, F.lit("v1") if venue is None else venue)
    return run_available(keyed, "ticks", ("venue", "date", "hour"))


def replay(recorded: DataFrame, start: str, end: str) -> DataFrame:
    """Recorded ticks in [start, end); the date predicate prunes the partitions."""
    t = F.col("event_time")
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return recorded.filter(F.col("date").between(F.to_date(lo), F.to_date(hi)) & (t >= lo) & (t < hi))


def stream_bars(ticks: DataFrame, width: str = "1 minute", lateness: str = TICK_LATENESS) -> DataFrame:
    """Bars closed by the watermark: a bar is emitted once, when no on-time tick can change it."""
    return minute_bars(ticks.withWatermark("event_time", lateness), width)


ORDER = "decimal(38,0)"


def partial_bars(ticks: DataFrame, width: str) -> DataFrame:
    """Bars that can still be merged: first and last price carry their (time, id) number."""
    order = (F.unix_micros("event_time").cast("decimal(18,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)") + F.col("trade_id").cast("decimal(19,0)")).cast(ORDER)
    d = ticks.groupBy("symbol", F.window("event_time", width).alias("w")).agg(
        F.min(order).alias("first_at"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(order).alias("last_at"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
    return d.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), *d.columns[2:])


def merged_bars(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "ts", "until").agg(
        F.min("first_at").alias("first_at"), F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last_at").alias("last_at"), F.max_by("close", "last_at").alias("close"), F.sum("volume").alias("volume"), F.sum("n_trades").alias("n_trades"))


class BarLog:
    """Bars of a tick stream with a side table of late ticks, so that every tick is in exactly one of ``bars``, ``open`` and ``late``.

    The mark is the newest event time of all earlier micro-batches less ``lateness``.  A tick whose bar ends at or before the mark is late: it goes
    to the side table unchanged, with the mark that shut it out, and no bar changes any more.  Other ticks are added to the open bars, which a micro-batch
    takes over from the one before as merged aggregates; bars that end by the new mark are closed.  A micro-batch that runs again reads the
    same opening tables and overwrites its own, so a restart from ``folder`` neither loses nor repeats a tick.  A null symbol is a symbol;
    a tick without an event time belongs to no bar and is late with reason ``no_time``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, width: str = "1 minute", lateness: str = TICK_LATENESS) -> None:
        self.spark, self.folder, self.width, self.lateness = spark, folder or work_folder(spark, "bar-log"), width, lateness

    def _write(self, d: DataFrame, name: str, epoch: int) -> None:
        d.write.mode("overwrite").parquet(f"{self.folder}/{name}/epoch={epoch}")

    def _micro_batch(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            before = self.spark.read.parquet(f"{self.folder}/mark/epoch={epoch - 1}").first()["newest"] if epoch else None
            newest = max((t for t in (before, batch.agg(F.max("event_time")).first()[0]) if t is not None), default=None)
            shut, close = (F.lit(t).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}") for t in (before, newest))
            until = F.window("event_time", self.width)["end"]
            no_time = F.col("event_time").isNull()
            late = F.coalesce(no_time | (until <= shut), F.lit(False))
            tagged = batch.withColumns({"late_reason": F.when(no_time, "no_time").otherwise("closed"), "mark": shut})
            # the window expression leaves rows without a time out, so these are added by themselves
            self._write(tagged.filter(~no_time).withColumn("_late", late).filter("_late").drop("_late").unionByName(tagged.filter(no_time)), "late", epoch)
            parts = partial_bars(batch.filter(~no_time).withColumn("_late", late).filter("NOT _late").drop("_late"), self.width)
            if epoch:
                parts = parts.unionByName(self.spark.read.parquet(f"{self.folder}/merged/epoch={epoch - 1}").filter("NOT closed").drop("closed"))
            self._write(merged_bars(parts).withColumn("closed", F.coalesce(F.col("until") <= close, F.lit(False))), "merged", epoch)
            self._write(self.spark.range(1).select(F.lit(newest).cast("timestamp").alias("newest")), "mark", epoch)
        finally:
            batch.unpersist()

    def run(self, ticks: DataFrame) -> None:
        """Take in all that the stream has now; a later call goes on where this one ended."""
        ticks.writeStream.foreachBatch(self._micro_batch).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def bars(self) -> DataFrame:
        return self._table("merged").filter("closed").drop("closed", "epoch", "until", "first_at", "last_at")

    def open_bars(self) -> DataFrame:
        """The bars that the newest micro-batch left open."""
        last = self._table("mark").agg(F.max("epoch")).first()[0]
        return self._table("merged").filter((F.col("epoch") == last) & ~F.col("closed")).drop("closed", "epoch", "until", "first_at", "last_at")

    def late(self) -> DataFrame:
        return self._table("late").drop("epoch")


def heartbeat(ticks: DataFrame) -> DataFrame:
    """Newest event time per symbol."""
    return ticks.groupBy("symbol").agg(F.max("event_time").alias("last_tick"))


def freshness(last: DataFrame, now: Column, is_crypto: Column, crypto_seconds: int = 60, equity_seconds: int = 300) -> DataFrame:
    gap = (F.unix_micros(now) - F.unix_micros(F.col("last_tick").cast("timestamp"))) / 1e6
    return last.withColumn("gap_seconds", gap).withColumn("fresh", gap <= F.when(is_crypto, crypto_seconds).otherwise(equity_seconds))
