"""Bindings of the operators' input tables to the given star-schema tables.

``bars`` has one row per (symbol, date), so a per-symbol window over it is bounded by the number of
trading days however many order lines a symbol has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import by, logret
from quantloom.session import by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV rows as their aggregation leaves them, by (symbol, date), for joins on both; every aggregate combines on the map side, so a hot symbol is no hot task."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.lit(0).cast("decimal(38,0)")
    # one fixed-width number instead of a struct keeps the aggregation hash-based (no sort of the raw rows)
    for c, digits in (("l_orderkey", 12), ("l_linenumber", 1), ("l_partkey", 11)):
        order = (order * F.lit(10 ** digits).cast(f"decimal({digits + 1},0)") + F.col(c).cast("decimal(20,0)")).cast("decimal(38,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    order = (order * F.lit(10 ** 9).cast("decimal(10,0)") + cents).cast("decimal(38,0)")
    order = (order * F.lit(100).cast("decimal(3,0)") + F.col("l_quantity").cast("decimal(20,0)")).cast("decimal(38,0)")
    return (li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
                 F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume")))


def by_symbol(df: DataFrame, sf_dir: str) -> DataFrame:
    return by_key(df, table(df.sparkSession, sf_dir, "lineitem"), "symbol")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV panel, partitioned for windows by symbol."""
    return by_symbol(daily(spark, sf_dir), sf_dir)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("ret", logret("close", 1, by()))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").filter("value > 0")
    return ev.select(
        F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("trade_id"),
        F.col("value").alias("price"),
        (F.from_json("props", "k INT")["k"].cast("double") + 1).alias("size"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), 1.0).otherwise(-1.0).alias("aggressor_sign"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(by())
    return (bars(spark, sf_dir).withColumn("rn", rn).filter("rn % 37 = 0")
            .select("symbol", F.col("date").alias("ex_date"), (F.col("close") * 0.01).alias("dividend_per_share")))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry")))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).filter("symbol % 7 <> 0").select(
        "symbol", "date", ((F.col("symbol") % 5 != 0) | (F.year("date") % 2 == 0)).alias("in_index"))


def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("symbol")
    reason = (F.when(s % 5 == 0, "merger").when(s % 5 == 1, "bankruptcy").when(s % 5 == 2, "voluntary")
              .when(s % 5 == 3, "acquired").otherwise("other"))
    return (bars(spark, sf_dir).filter("symbol % 4 <> 0").groupBy("symbol").agg(F.max("date").alias("exit_date"))
            .withColumn("exit_reason", reason)
            .withColumn("terminal_return_known", s % 3 == 0)
            .withColumn("terminal_return_value", F.when(s % 3 == 0, -0.01 * (s % 10))))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored factor rows: target, prediction and weight per order line."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("symbol"), F.to_date("o_orderdate").alias("date"),
        (F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("row_id"),
        (F.col("l_discount") - 0.05).alias("y"), (F.col("l_tax") - 0.04).alias("pred"), (F.col("l_quantity") / 10.0).alias("w"))
