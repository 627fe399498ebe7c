"""Ordinal ranks and per-group statistics that do not pull a whole group into one task.

A date can hold a very large cross-section, so a plain window partitioned by date would sort it in
one task.  ``ordinal`` splits every group by a fixed monotone bin of the value, numbers rows inside
(group, bin) and adds the number of rows in the lower bins.  The result equals ``row_number`` over
the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import col, div

_UNIT, _BINS_PER_E = 1e6, 32.0
_NULL_BIN = 1 << 40
_INTEGERS = 16.0


def _raw_bin(v: Column) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * _UNIT) * _BINS_PER_E)


def value_bin(value: str | Column) -> Column:
    """Monotone integer bin, fine near zero and about 3% wide elsewhere; nulls come last.

    Integers up to 16 (zero signals, codes, small counts) have a bin of their own: the third of
    ``3 * bin + side`` says below, at or above the only integer the bin can hold.
    """
    v = col(value).cast("double")
    i, b = F.round(v), _raw_bin(v)
    side = F.when(F.abs(v) > _INTEGERS, 0).when(v == i, 1).when(_raw_bin(i) == b, F.when(v < i, 0).otherwise(2)).otherwise(0)
    return F.when(v.isNull(), F.lit(_NULL_BIN)).otherwise(b * 3 + side)


def ordinal(df: DataFrame, value: str | Column, name: str, part: Sequence[str] = ("date",),
            ties: Sequence[str] = ("symbol",), descending: bool = False, size: str | None = None) -> DataFrame:
    """Add 1-based ordinal rank ``name`` within ``part`` (ties by ``ties``), and the group size.

    Rows that share one small integer value or are null are ordered by the tie key alone, so their bin
    is split further by it.
    """
    v = -col(value).cast("double") if descending else col(value).cast("double")
    keys = [*part, "_bin", "_sub"]
    numbered = df.withColumn("_v", v).withColumn("_bin", value_bin(F.col("_v")))
    numeric = bool(ties) and dict(df.dtypes)[ties[0]] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    alone = F.col("_v").isNull() | ((F.abs("_v") <= _INTEGERS) & (F.col("_v") == F.round("_v")))
    numbered = numbered.withColumn("_sub", F.when(alone, F.coalesce(_raw_bin(F.col(ties[0]).cast("double")), F.lit(_NULL_BIN))).otherwise(F.lit(0)) if numeric else F.lit(0))
    numbered = numbered.withColumn("_rn", F.row_number().over(
        W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last(), *[F.col(t).asc_nulls_last() if numeric and t == ties[0] else F.col(t) for t in ties])))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    below = W.partitionBy(*part).orderBy("_bin", "_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"),
                           F.sum("_n").over(W.partitionBy(*part)).alias("_grp"))
    out = numbered.join(offsets, keys).withColumn(name, F.col("_rn") + F.col("_off"))
    if size:
        out = out.withColumn(size, F.col("_grp"))
    return out.drop("_v", "_bin", "_sub", "_rn", "_off", "_grp")


def with_group_stats(df: DataFrame, part: Sequence[str], calendar_sized: bool = False, **aggs: Column) -> DataFrame:
    """Join group aggregates back (partial aggregation, so no hot task).

    ``calendar_sized`` marks a statistics table with at most one row per date: it is bounded by the
    calendar and is broadcast; otherwise the engine decides from the measured size.
    """
    stats = df.groupBy(*part).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(F.broadcast(stats) if calendar_sized else stats, list(part), "left")


def scaled_ranks(panel: DataFrame, columns: Sequence[str], universe: str, date: str = "date",
                 symbol: str = "symbol") -> DataFrame:
    """Ranks scaled to [-0.5, 0.5] inside the universe, ``rank_<column>``; null when one name or fewer.

    All columns are ranked in one pass over a narrow (date, symbol, column number, value) table.
    """
    long = panel.filter(F.col(universe)).select(date, symbol, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("col", "val"))
    ranked = ordinal(long, "val", "_r", part=(date, "col"), ties=(symbol,), size="_cnt")
    scaled = F.when(F.col("val").isNotNull() & (F.col("_cnt") > 1), (F.col("_r") - 1.0) / (F.col("_cnt") - 1.0) - 0.5)
    wide = ranked.withColumn("_s", scaled).groupBy(date, symbol).agg(*[F.max(F.when(F.col("col") == i, F.col("_s"))).alias(f"rank_{c}") for i, c in enumerate(columns)])
    return panel.join(wide, [date, symbol], "left")


def zero_based_rank(panel: DataFrame, column: str, name: str, date: str = "date", symbol: str = "symbol") -> DataFrame:
    return ordinal(panel, column, "_r", (date,), (symbol,)).withColumn(
        name, F.when(F.col(column).isNotNull(), F.col("_r") - 1)).drop("_r")


def eligible_rank(panel: DataFrame, prediction: str, eligible: Column, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """``rank`` of the prediction among eligible rows, null elsewhere, and the eligible count."""
    ok = panel.filter(eligible)
    ranked = ordinal(ok, prediction, "rank", (date,), (symbol,), size="n_eligible").select(date, symbol, "rank", "n_eligible")
    return panel.join(ranked, [date, symbol], "left")


def rank_ic_by_date(df: DataFrame, prediction: str, target: str, date: str = "date", symbol: str = "symbol",
                    min_rows: int = 3) -> DataFrame:
    """Pearson correlation of ordinal ranks per date."""
    both = df.filter(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    r = ordinal(ordinal(both, prediction, "_rp", (date,), (symbol,)), target, "_rt", (date,), (symbol,))
    return (r.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.corr("_rp", "_rt").alias("rank_ic"))
            .filter(F.col("n") >= min_rows).withColumn("rank_ic", F.coalesce(F.nanvl("rank_ic", F.lit(0.0)), F.lit(0.0))))


def top_bottom_by_date(df: DataFrame, score: str, outcome: str, q: float, date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Mean outcome of the top and bottom fraction and their spread: n = max(1, floor(q*N)), at most N/2."""
    r = ordinal(df, score, "_r", (date,), (symbol,), size="_size")
    n = F.least(F.greatest(F.floor(F.col("_size") * q), F.lit(1)), F.floor(F.col("_size") / 2))
    top = F.when(F.col("_r") > F.col("_size") - n, F.col(outcome))
    bottom = F.when(F.col("_r") <= n, F.col(outcome))
    return (r.filter(F.col("_size") >= 2).groupBy(date)
            .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(top).alias("top_return"), F.avg(bottom).alias("bottom_return"))
            .withColumn("spread", F.col("top_return") - F.col("bottom_return")))


def spearman(df: DataFrame, x: str, y: str, part: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Rank correlation per cohort with its t-statistic."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = ordinal(ordinal(both, x, "_rx", part, ties), y, "_ry", part, ties)
    out = r.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    t = F.col("rho") * F.sqrt(div(F.col("n") - 2, F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-12))))
    return out.withColumn("t_stat", F.when(F.col("n") > 2, t))
