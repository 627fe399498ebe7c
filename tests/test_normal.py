"""The normal distribution against the standard library."""

from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from quantloom.functions.normal import norm_cdf, norm_ppf


def test_cdf_and_quantile(spark):
    n = NormalDist()
    z = [i / 16 for i in range(-320, 321)]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", norm_cdf("z").alias("p")).collect():
        assert r.p == pytest.approx(n.cdf(r.z), rel=1e-9, abs=1e-15)
    p = [1e-300, 1e-20, 1e-9, *[i / 1000 for i in range(1, 1000)], 1 - 1e-12]
    for r in spark.createDataFrame([(x,) for x in p], "p double").select("p", norm_ppf("p").alias("z")).collect():
        assert r.z == pytest.approx(n.inv_cdf(r.p), rel=1e-9, abs=1e-12)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),), (0.0,), (1.0,)], "x double").select(norm_cdf("x").alias("c"), norm_ppf("x").alias("q")).collect()
    assert [r.c for r in odd][:4] == [None, None, 1.0, 0.0] and [r.q for r in odd] == [None] * 6


def test_no_python_in_the_plan(spark):
    plan = spark.range(3).select(norm_cdf(F.col("id")), norm_ppf(F.col("id") / 4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
