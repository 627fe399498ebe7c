"""Cross-validation splits as small fold tables joined to the rows.

Folds are computed on the distinct dates (or integer groups), a calendar-sized table; rows only meet
the resulting (date, fold, role) list by an equi join.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def date_index(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with a dense 0-based index and their number."""
    d = df.select(date).distinct().withColumn("idx", F.row_number().over(W.orderBy(date)) - 1)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return d.crossJoin(F.broadcast(n))  # one-row side


def holdout_dates(df: DataFrame, fraction: float, rounding: str = "round", date: str = "date") -> DataFrame:
    """Dates of the last fraction: ``round`` max(1, round(n·f)), ``keep`` n - round(n·(1-f)), ``floor`` max(1, int(n·f)).  Rounds half to even."""
    n = F.col("n")
    k = {"round": F.greatest(F.bround(n * fraction), F.lit(1)), "keep": n - F.bround(n * (1.0 - fraction)), "floor": F.greatest(F.floor(n * fraction), F.lit(1))}[rounding]
    return date_index(df, date).filter(F.col("idx") >= n - k).select(date)


def chronological_blocks(df: DataFrame, k: int, date: str = "date") -> DataFrame:
    """Date to one of k equal blocks; the last one takes the remainder."""
    d = date_index(df, date)
    size = F.greatest(F.floor(F.col("n") / k), F.lit(1))
    return d.select(date, F.least(F.floor(F.col("idx") / size), F.lit(k - 1)).cast("int").alias("block"))


def three_way(df: DataFrame, dev: float, validation: float, date: str = "date") -> DataFrame:
    d = date_index(df, date)
    a, b = F.floor(F.col("n") * dev), F.floor(F.col("n") * (dev + validation))
    return d.select(date, F.when(F.col("idx") < a, "development").when(F.col("idx") < b, "validation").otherwise("holdout").alias("period"))


def _with_folds(dates: DataFrame, folds: int) -> DataFrame:
    return dates.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))


def purged_kfold(df: DataFrame, folds: int, purge: int = 5, embargo: int = 5, group: str = "date_id") -> DataFrame:
    """(group, fold, role) with train groups outside [min test − purge, max test + embargo] by value of the integer group."""
    d = date_index(df, group)
    size = F.floor(F.col("n") / folds)
    d = _with_folds(d, folds)
    lo, hi = F.col("fold") * size, F.when(F.col("fold") == folds - 1, F.col("n")).otherwise((F.col("fold") + 1) * size)
    d = d.withColumn("_test", (F.col("idx") >= lo) & (F.col("idx") < hi))
    b = d.filter("_test").groupBy("fold").agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    d = d.join(F.broadcast(b), "fold")
    train = (F.col(group) < F.col("_lo") - purge) | (F.col(group) > F.col("_hi") + embargo)
    return d.withColumn("role", F.when(F.col("_test"), "test").when(train, "train")).filter("role IS NOT NULL").select(group, "fold", "role")


def combinatorial_splits(df: DataFrame, blocks: int = 8, test_blocks: int = 2, horizon: int = 5, embargo: int = 5, date: str = "date") -> DataFrame:
    """(date, split, role) for all choices of test blocks.

    A train date is dropped when its label window [t, t+h] meets a test date, and inside the embargo after
    the largest test date only.  Test dates form at most ``test_blocks`` runs, so the purge is a
    look-ahead window over the date's rows of the split.
    """
    combos = list(itertools.combinations(range(blocks), test_blocks))
    d = date_index(df, date)
    size = F.floor(F.col("n") / blocks)
    d = d.withColumn("_b", F.least(F.floor(F.col("idx") / size), F.lit(blocks - 1)))
    tests = F.array(*[F.array(*[F.lit(x).cast("long") for x in c]) for c in combos])
    d = d.select(date, "idx", "_b", F.posexplode(tests).alias("split", "_tests")).withColumn("_test", F.array_contains("_tests", F.col("_b")))
    w = W.partitionBy("split").orderBy("idx")
    d = d.withColumns({"_soon": F.max(F.col("_test").cast("int")).over(w.rowsBetween(0, horizon)), "_last": F.max(F.when(F.col("_test"), F.col("idx"))).over(W.partitionBy("split"))})
    inside = (F.col("idx") > F.col("_last")) & (F.col("idx") < F.col("_last") + 1 + embargo)
    return d.withColumn("role", F.when(F.col("_test"), "test").when((F.col("_soon") == 0) & ~inside, "train")).filter("role IS NOT NULL").select(date, "split", "role")


def expanding_folds(df: DataFrame, folds: int, purge_days: int, embargo_days: int, date: str = "date") -> DataFrame:
    """Expanding training windows with a purge in calendar days and an embargo after the previous validation end."""
    d = _with_folds(date_index(df, date), folds)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / (folds + 1)))
    start = (F.col("fold") + 1) * size
    end = F.least(F.col("n"), start + size)
    d = d.withColumns({"_val": (F.col("idx") >= start) & (F.col("idx") < end), "_start": start})
    b = d.filter("_val").groupBy("fold").agg(F.min(date).alias("_first"), F.max(date).alias("_end"))
    prev = b.select((F.col("fold") + 1).alias("fold"), F.col("_end").alias("_prev"))
    d = d.join(F.broadcast(b), "fold").join(F.broadcast(prev), "fold", "left")
    embargoed = F.coalesce((F.col(date) > F.col("_prev")) & (F.col(date) <= F.date_add("_prev", embargo_days)), F.lit(False))
    train = (F.col("idx") < F.col("_start")) & (F.col(date) <= F.date_sub("_first", purge_days)) & ~embargoed
    return d.withColumn("role", F.when(F.col("_val"), "validation").when(train, "train")).filter("role IS NOT NULL").select(date, "fold", "role")


def rolling_year_windows(df: DataFrame, train_years: int, valid_years: int, step_years: int = 1, max_windows: int = 200, date: str = "date") -> DataFrame:
    """Growing train window from the first date and a validation span after it, moved by whole 365.25-day years."""
    d = df.select(date).distinct()
    ends = d.agg(F.min(date).alias("_s"), F.max(date).alias("_e"))
    tr, va, st = (int(y * 365.25) for y in (train_years, valid_years, step_years))
    cuts = ends.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(max_windows)))).withColumn("_cut", F.date_add(F.date_add("_s", tr), F.col("window") * st))
    cuts = cuts.filter(F.date_add("_cut", va) <= F.col("_e")).withColumn("_stop", F.date_add("_cut", va))
    arr = cuts.agg(F.collect_list(F.struct("window", "_cut", "_stop")).alias("_w"))  # one row with a few windows
    x = d.crossJoin(F.broadcast(arr)).select(date, F.explode("_w").alias("_w")).select(date, "_w.*")
    return x.withColumn("role", F.when(F.col(date) < F.col("_cut"), "train").when(F.col(date) < F.col("_stop"), "validation")).filter("role IS NOT NULL").select(date, "window", "role")


def walk_forward(df: DataFrame, min_train: int, test: int, step: int, last_folds: int | None = None, date: str = "date") -> DataFrame:
    """Expanding date walk-forward; with ``last_folds`` only the newest folds, renumbered from 0."""
    d = date_index(df, date)
    count = F.when(F.col("n") <= min_train, 0).otherwise(F.greatest(F.ceil((F.col("n") - min_train - test) / step), F.lit(0)) + 1).cast("int")
    d = d.withColumn("_folds", count).filter("_folds > 0").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("_folds") - 1)))
    if last_folds:
        d = d.withColumn("_skip", F.greatest(F.col("_folds") - last_folds, F.lit(0))).filter("fold >= _skip")
    else:
        d = d.withColumn("_skip", F.lit(0))
    end = F.lit(min_train) + F.col("fold") * step
    role = F.when(F.col("idx") < end, "train").when(F.col("idx") < end + test, "test")
    return d.withColumn("role", role).filter("role IS NOT NULL").select(date, (F.col("fold") - F.col("_skip")).alias("fold"), "role")


def fold_scaler(rows: DataFrame, folds: DataFrame, columns: Sequence[str], date: str = "date") -> DataFrame:
    """Standardise every fold's rows by its training mean and population deviation; the fit dates are kept for the overlap guard."""
    d = rows.join(F.broadcast(folds), date)
    tr = F.col("role") == "train"
    fit = d.groupBy("fold").agg(*[F.avg(F.when(tr, F.col(c))).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(F.when(tr, F.col(c))).alias(f"_s_{c}") for c in columns],
                                F.max(F.when(tr, F.col(date))).alias("fit_until"))
    d = d.join(F.broadcast(fit), "fold")
    return d.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(
        *[f"_{k}_{c}" for k in "ms" for c in columns])


def overlap_rows(folds: DataFrame, date: str = "date") -> DataFrame:
    """Dates that are in train and in evaluation of one fold (must be none)."""
    tr = folds.filter("role = 'train'").select(date, "fold")
    return folds.filter("role <> 'train'").join(tr, [date, "fold"], "left_semi")
