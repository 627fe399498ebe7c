"""The number of partitions of the bars follows the size of the input, whatever adaptive execution makes of their narrow rows."""

from pyspark.sql import functions as F

from quantloom import session
from quantloom.functions.columns import by
from quantloom.plans.views import bars


def test_windows_over_bars_get_bounded_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1 << 14)
    size = spark.read.parquet(f"{sf}/lineitem.parquet")._jdf.queryExecution().analyzed().stats().sizeInBytes()
    d = bars(spark, sf).withColumn("n", F.row_number().over(by()))
    parts = d.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert max(r.p for r in parts) + 1 <= -(-int(str(size)) // (1 << 14)) and len(parts) > spark.sparkContext.defaultParallelism / 2
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_grids_are_counted_where_they_are_expanded(spark, sf, monkeypatch):
    from quantloom.operators import grids
    from quantloom.plans.catalog import all_queries

    monkeypatch.setattr(grids, "GRID_SYMBOLS", 4)
    d = all_queries()["variant_grids"].fn(spark, sf)
    exchanges = [line for line in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not [line for line in exchanges if "variant" in line]  # no row of a grid is shuffled
    base = grids.dealt(spark.read.parquet(f"{sf}/supplier.parquet").withColumnRenamed("s_suppkey", "symbol"))
    assert base.rdd.getNumPartitions() == -(-base.count() // 4)


def test_windows_over_normalised_bars_keep_bounded_partitions(spark, sf, monkeypatch):
    from quantloom.plans.catalog import all_queries

    monkeypatch.setattr(session, "PART_BYTES", 1 << 14)
    plan = all_queries()["past_only_features"].fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("REPARTITION_BY_NUM")]
    assert "Window" in above and "ENSURE_REQUIREMENTS" not in above  # no shuffle that adaptive execution may merge lies between the windows and the parts
