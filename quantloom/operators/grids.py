"""Parameter grids as DataFrames built from a few literal axes.

A grid's size is the product of its axes, fixed by the caller and independent of the data; the axes
are exploded one after the other on the cluster, so no grid is built on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.noise import uniform
from quantloom.operators.signals import FAMILIES, strategy_id

LOOKBACKS, THRESHOLDS = (10, 20, 60, 120), (0.5, 1.0, 1.5, 2.0, 2.5)
ZOO_AXES = {
    "family": FAMILIES, "lookback": (5, 10, 20, 40, 60, 120, 180, 252), "threshold": (0.25, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0),
    "vol_estimator": ("close_to_close", "parkinson", "rogers_satchell"), "position_mode": ("long_only", "long_short"), "holding": (1, 5, 10)}


def expand(base: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """One row per base row and combination of the axes."""
    d = base
    for name, values in axes.items():
        d = d.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return d


GRID_SYMBOLS = 256  # in one partition: a grid turns a symbol into some thousand rows


def dealt(base: DataFrame) -> DataFrame:
    """``base`` partitioned by symbol into parts of ``GRID_SYMBOLS``, whatever the bytes of its files.

    A grid's rows exist only behind its explodes, so the size of the input says nothing of them; aggregates by symbol then need no shuffle of the grid.
    """
    return base.repartition(max(1, -(-base.count() // GRID_SYMBOLS)), "symbol")


def benchmark_grid(universes: DataFrame) -> DataFrame:
    """universe × family × lookback × threshold; ``universes`` has the column ``symbol``."""
    return expand(universes.select("symbol"), {"family": FAMILIES, "lookback": LOOKBACKS, "threshold": THRESHOLDS}).withColumn(
        "strategy_id", strategy_id("symbol", "family", "lookback", "threshold"))


def zoo_grid(universes: DataFrame, cap: int | None = None, seed: int = 42, axes: dict[str, Sequence] | None = None) -> DataFrame:
    """Seven-parameter grid, optionally a keyed random sample of ``cap`` strategies (the sample is the feature)."""
    spec = ["symbol", *(axes or ZOO_AXES)]
    d = expand(universes.select("symbol"), axes or ZOO_AXES).withColumn("strategy_id", strategy_id(*spec))
    return d if cap is None else d.orderBy(uniform("strategy_id", seed=seed), "strategy_id").limit(cap)


# Defaults of this package, not checked against published settings: execution profiles (name, min score, min edge multiple, side, holding, cooldown, delay).
PROFILES = (("base", 0.0, 0.0, "both", 1, 0, 0), ("edge_1x", 0.0, 1.0, "both", 1, 0, 0), ("edge_2x", 0.0, 2.0, "both", 1, 0, 0), ("long_only", 0.0, 0.0, "long_only", 1, 0, 0),
            ("short_only", 0.0, 0.0, "short_only", 1, 0, 0), ("hold_5", 0.0, 0.0, "both", 5, 0, 0), ("hold_15", 0.0, 0.0, "both", 15, 0, 0), ("cooldown_5", 0.0, 0.0, "both", 1, 5, 0),
            ("cooldown_15", 0.0, 0.0, "both", 1, 15, 0), ("delay_1", 0.0, 0.0, "both", 1, 0, 1), ("strict", 0.5, 2.0, "both", 5, 5, 0), ("strict_delay", 0.5, 2.0, "both", 5, 5, 1))


def bar_variants(base: DataFrame) -> DataFrame:
    """Minute-bar variants of six families crossed with the execution profiles, for every symbol of ``base``."""
    axes = {"momentum": (5, 15, 30, 60, 120, 240), "mean_reversion": (15, 30, 60, 120, 240), "breakout": (30, 60, 120, 240), "volatility": (15, 30, 60, 120), "liquidity": (30, 60, 120, 240), "paper_derived": (60, 120, 240, 480)}
    grid = base.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(v) for v in vs]).alias("vs")) for f, vs in axes.items()])).alias("g"))
    d = grid.select("symbol", "g.family", F.explode("g.vs").alias("lookback")).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.0, 0.001, 0.002, 0.005)])))
    prof = F.array(*[F.struct(F.lit(p[0]).alias("profile"), F.lit(p[3]).alias("side"), F.lit(p[4]).alias("holding"), F.lit(p[5]).alias("cooldown"), F.lit(p[6]).alias("delay")) for p in PROFILES])
    return d.withColumn("_p", F.explode(prof)).select("symbol", "family", "lookback", "threshold", "_p.*").withColumn("variant_id", F.sha1(F.to_json(F.struct("symbol", "family", "lookback", "threshold", "profile"))))


def balanced(variants: DataFrame, target: int, group: str = "family", order: Sequence[str] = ("variant_id",)) -> DataFrame:
    """Round-robin over the groups up to ``target`` variants, after removing equal ids."""
    from quantloom.sources.market import keep_last
    d = keep_last(variants, ["variant_id"], [group], first=True)
    return d.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).orderBy("_rn", group).limit(target).drop("_rn")


def model_grid(base: DataFrame, models: Sequence[str], features: Sequence[str], horizons: Sequence[int], quantiles: Sequence[float], sides: Sequence[str]) -> DataFrame:
    return expand(base, {"model": models, "feature_set": features, "horizon": horizons, "quantile": quantiles, "side": sides}).withColumn(
        "variant", F.concat_ws("|", "model", "feature_set", F.col("horizon").cast("string"), F.col("quantile").cast("string"), "side"))
