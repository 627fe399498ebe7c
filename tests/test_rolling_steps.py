"""Long windows are put together from shorter ones in the one order of the series."""

import re

import pytest
from pyspark.sql import functions as F

from quantloom.functions import rolling as ro
from quantloom.plans.catalog import all_queries


@pytest.mark.parametrize("name", ["trend_fingerprint", "characteristics_pack"])
def test_windows_sort_once(spark, sf, name):
    p = all_queries()[name].fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Window [") and len(re.findall(r"-(59|119|251)\), currentrow", p)) == 0  # no long frame is evaluated from scratch
    main = p[:p.index("Aggregate")]
    assert main.count("Sort [symbol") <= 2


def test_parts_add_up():
    parts = ro.window_parts([5, 20, 21, 60, 63, 126, 252, 300])
    assert all(sum(p) == n for n, p in parts.items() if n > 1) and max(map(len, parts.values())) <= 8


def test_extremes_deviations_and_gaps(spark):
    rows = [(1, i, None if i % 9 == 4 else 5.0 if i < 120 else float(i * 37 % 101)) for i in range(400)]
    got = {r.t: r for r in ro.rolling(spark.createDataFrame(rows, "symbol long, date long, x double").withColumn("t", F.col("date")),
                                      {"hi": ("max", "x", 60), "lo": ("min", "x", 60), "sd": ("std", "x", 60)}, least=3).collect()}
    for i in range(400):
        v = [x for _, _, x in rows[max(0, i - 59):i + 1] if x is not None]
        assert (got[i].hi, got[i].lo) == ((max(v), min(v)) if len(v) >= 3 else (None, None))
    assert got[100].sd == 0.0  # equal values have no spread at all
