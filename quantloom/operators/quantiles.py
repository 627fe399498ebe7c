"""Exact quantiles of whole tables without a task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.session import stored

BINS = 1024
LEAF = 1 << 16


def exact_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], by: Sequence[str] = (), name: str = "q", bins: int = BINS, leaf: int = LEAF) -> DataFrame:
    """One row per group (one row without ``by``): the keys, ``name`` as an array of linear quantiles, and ``n``, the number of finite values.

    A quantile lies between two ranks.  The interval that holds a rank is cut into ``bins`` equal parts, whose counts (added up before any
    shuffle) tell the part with the rank; its least and largest value are the next interval.  Parts of at most ``leaf`` values are sorted, one task
    each; a value that fills its interval alone is the answer however often it occurs.  Every pass narrows the interval by its number of bins, so
    a table needs log(rows / leaf) / log(bins) passes unless its values are spread exponentially.  Nulls, NaN and infinities do not count; a group without
    finite values has null quantiles.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    group = F.struct(*by) if by else F.lit(0)
    d = stored(df.select(group.alias("_g"), v.alias("_v")))
    finite = d.filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    span = (d.groupBy("_g") if by else d).agg(F.count_if(F.abs("_v") < float("inf")).alias("n"), *[f(F.when(F.abs("_v") < float("inf"), F.col("_v"))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))])
    span = stored(span if by else span.select(F.lit(0).alias("_g"), "n", "low", "high"))
    at = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    state = span.filter("n > 0").select("_g", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("size"))
    inside = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    wide = (F.col("size") > leaf) & (F.col("low") < F.col("high"))
    open_ = state.filter(wide)
    while not open_.isEmpty():
        cut = finite.join(open_.select("_g", "low", "high", "before").distinct(), "_g").filter(inside)
        # halves: the width of the largest doubles has no double
        part = F.least(F.floor((F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins), F.lit(bins - 1))
        counts = cut.groupBy("_g", "low", "high", "before", part.alias("_b")).agg(F.count(F.lit(1)).alias("size"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        seen = F.coalesce(F.sum("size").over(W.partitionBy("_g", "low", "high").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")  # ``bins`` rows
        counts = counts.select("_g", "low", "high", "_l", "_h", "size", seen.alias("_s"))
        step = open_.select("_g", "rank", "low", "high").join(counts, ["_g", "low", "high"]).filter((F.col("rank") >= F.col("_s")) & (F.col("rank") < F.col("_s") + F.col("size")))
        step = step.select("_g", "rank", F.col("_l").alias("low"), F.col("_h").alias("high"), F.col("_s").alias("before"), "size")
        state = stored(state.filter(~wide).unionByName(step))
        open_ = state.filter(wide)
    known = state.filter("low = high").select("_g", "rank", F.col("low").alias("_v"))
    rest = state.filter("low < high")
    small = finite.join(rest.select("_g", "low", "high", "before").distinct(), "_g").filter(inside)
    small = small.select("_g", "low", "high", "_v", (F.row_number().over(W.partitionBy("_g", "low", "high").orderBy("_v")) - 1 + F.col("before")).alias("rank"))  # at most ``leaf`` rows
    found = known.unionByName(rest.select("_g", "rank", "low", "high").join(small, ["_g", "low", "high", "rank"]).select("_g", "rank", "_v"))
    found = found.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_m"))  # two entries a quantile
    out = span.select("_g", "n").join(found, "_g", "left")

    def quantile(x: Column) -> Column:
        low, high = F.element_at("_m", F.floor(x).cast("long")), F.element_at("_m", F.ceil(x).cast("long"))
        return low + (high - low) * (x - F.floor(x))

    keys = [F.col(f"_g.{c}").alias(c) for c in by]
    return out.select(*keys, F.array(*[quantile(x) for x in at]).alias(name), "n")
