"""Sink, artifact, plug-in and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.columns import div
from quantloom.operators import grids as gr
from quantloom.operators import plugins as pl
from quantloom.operators import signals as sg
from quantloom.operators.features import drawdown
from quantloom.plans.queries_market import RET, small_returns
from quantloom.plans.registry import query
from quantloom.plans.sqltext import windows
from quantloom.plans.views import bars, table, ticks
from quantloom.sources import market as mk
from quantloom.sources import tables as tb
from quantloom.streaming.record import work_folder


@query("SRC8 SRC20 SRC6 SRC23", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", "total", digits=2)
def verified_artifact(spark, sf):
    folder = work_folder(spark, "artifact")
    tb.write_shards(table(spark, sf, "orders"), folder, rows_per_file=50_000)
    manifest = tb.file_hashes(spark, folder).select("path", "sha256")
    return tb.verified_read(spark, folder, manifest).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("SRC21 SRC24", "WITH @ticks SELECT symbol % 8 AS symbol, count(*) AS n, sum(price) AS total FROM ticks GROUP BY 1", "total", digits=3)
def feature_files(spark, sf):
    folder = work_folder(spark, "features")
    d = ticks(spark, sf).withColumn("symbol", F.col("symbol") % 8)
    tb.write_shards(d.select("symbol", "event_time", "price"), folder, partition_by=["symbol"])
    back = spark.read.parquet(folder)
    return back.groupBy(F.col("symbol").cast("long").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("SRC17", "SELECT 'lineitem.parquet' AS source_file, count(*) AS n, sum(l_extendedprice) AS total FROM (SELECT * FROM lineitem LIMIT 1000)", "total", digits=2)
def first_rows_per_file(spark, sf):
    d = mk.first_rows_per_file(table(spark, sf, "lineitem"), 1000, "l_discount")
    return d.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))


@query("RK13 WN37", f"""WITH @bars, {RET}, d AS (SELECT symbol % 5 AS book, date, avg(ret) AS r FROM ret GROUP BY 1, 2), e AS (SELECT *, product(1 + r) OVER (PARTITION BY book ORDER BY date) AS eq FROM d), p AS (SELECT *, eq / max(eq) OVER (PARTITION BY book ORDER BY date) - 1 AS dd, arg_max(date, eq) OVER (PARTITION BY book ORDER BY date) AS peak_date FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY dd, date) AS rank FROM p) SELECT book, rank, date AS trough_date, peak_date, dd AS drawdown FROM t WHERE rank <= 10""", "drawdown")
def deepest_drawdowns(spark, sf):
    from pyspark.sql import Window as W
    d = small_returns(spark, sf).groupBy((F.col("symbol") % 5).alias("book"), "date").agg(F.avg("ret").alias("r"))
    e = drawdown(d, "r", ["book"], ["date"])
    e = e.withColumn("peak_date", F.max_by("date", "equity").over(W.partitionBy("book").orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    e = e.withColumn("rank", F.row_number().over(W.partitionBy("book").orderBy("drawdown", "date"))).filter("rank <= 10")
    return e.select("book", "rank", F.col("date").alias("trough_date"), "peak_date", "drawdown")


@query("RK12 RK10", """WITH r AS (SELECT p_type AS family, CAST(p_partkey AS VARCHAR) AS variant_id, row_number() OVER (PARTITION BY p_type ORDER BY CAST(p_partkey AS VARCHAR)) AS rn FROM part) SELECT family, variant_id FROM r ORDER BY rn, family LIMIT 50""")
def balanced_selection(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("family"), F.col("p_partkey").cast("string").alias("variant_id"))
    return gr.balanced(p.unionByName(p), 50)


@query("GRD3 GRD4 JN20", "SELECT s_suppkey AS symbol, CAST(1296 AS BIGINT) AS n_bar_variants, CAST(72 AS BIGINT) AS n_model_variants FROM supplier")
def variant_grids(spark, sf):
    u = gr.dealt(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol")))
    b = gr.bar_variants(u).groupBy("symbol").agg(F.countDistinct("variant_id").alias("n_bar_variants"))
    m = gr.model_grid(u, ["ridge", "huber", "elastic_net"], ["base", "wide"], [15, 60], [0.9, 0.95, 0.99], ["both", "long_only"]).groupBy("symbol").agg(F.countDistinct("variant").alias("n_model_variants"))
    return b.join(m, "symbol")


class RateOfChange(pl.Strategy):
    """Sign of the n-row rate of change beyond a threshold."""

    name = "roc_20"

    def positions(self, bars: DataFrame) -> DataFrame:
        return sg.signal_table(bars, ["ROC"], [20], [2.0]).select("symbol", "date", F.col("signal").alias("position"))


class ProbabilityFilter(pl.Wrapper):
    """Keep positions on even days of the month (a stand-in for a probability filter)."""

    name = "even_days"

    def wrap(self, bars: DataFrame, positions: DataFrame) -> DataFrame:
        return positions.withColumn("position", F.when(F.dayofmonth("date") % 2 == 0, F.col("position")).otherwise(0.0))


@query("UD1 UD2", f"""WITH @bars, a AS (SELECT symbol, date, close / lag(close, 20) OVER wk - 1 AS roc FROM bars {windows()}) SELECT symbol, date, CASE WHEN day(date) % 2 = 0 THEN CASE WHEN roc > 0.02 THEN 1.0 WHEN roc < -0.02 THEN -1.0 ELSE 0 END ELSE 0 END::DOUBLE AS position FROM a""")
def plugin_strategy(spark, sf):
    registry = pl.Registry()
    registry.register("strategy", RateOfChange())
    registry.register("wrapper", ProbabilityFilter())
    b = bars(spark, sf)
    return registry.get("wrapper", "even_days").wrap(b, registry.get("strategy", "roc_20").positions(b))


@query("UD5 FN6", "SELECT sha256(text) AS key, CAST(any_value(length(text)) AS DOUBLE) AS score FROM documents GROUP BY 1", "score")
def cached_scores(spark, sf):
    d = table(spark, sf, "documents")
    score = lambda t: t.str.len().astype(float)
    cache = pl.cached_scores(d.filter("doc_id % 2 = 0"), None, score)
    return pl.cached_scores(d, cache, score)
