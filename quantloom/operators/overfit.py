"""Overfitting and inference statistics over long return tables (date, strategy_id, ret).

Nothing is ever held as a dates × strategies matrix.  Strategies are rows; of the combinatorial
splits only their list travels to the tasks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import by, div
from quantloom.functions.noise import counter_uniform, key32, uniform
from quantloom.functions.normal import norm_cdf, norm_ppf
from quantloom.operators.quantiles import exact_quantiles
from quantloom.session import durable, spread, stored

MIN_BLOCK_ROWS = 5
EULER = 0.5772156649015329
YEAR = math.sqrt(252.0)


def split_masks(blocks: int, max_splits: int | None = None, seed: int = 42) -> np.ndarray:
    """In-sample masks of all half-size block combinations; the caller may ask for a fixed sample of ``max_splits`` of them."""
    if blocks % 2:
        raise ValueError(f"the number of blocks must be even, not {blocks}")
    total = math.comb(blocks, blocks // 2)
    if max_splits is None or total <= max_splits:
        combos = list(itertools.combinations(range(blocks), blocks // 2))
    else:
        rng = np.random.default_rng(seed)
        seen: set[tuple[int, ...]] = set()
        while len(seen) < max_splits:
            seen.add(tuple(sorted(rng.choice(blocks, size=blocks // 2, replace=False).tolist())))
        combos = sorted(seen)
    mask = np.zeros((len(combos), blocks), dtype=bool)
    for i, c in enumerate(combos):
        mask[i, list(c)] = True
    return mask


def block_of_dates(returns: DataFrame, blocks: int, drop_tail: bool = True) -> tuple[DataFrame, DataFrame]:
    """Date to block (equal blocks dropping the tail, or floor(i*P/n)) and the one-row block size table; calendar-sized."""
    d = returns.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")) - 1)
    n = d.agg(F.count(F.lit(1)).alias("_t"))
    d = d.crossJoin(F.broadcast(n))  # one-row side
    if drop_tail:
        d = d.withColumn("_size", F.floor(F.col("_t") / blocks)).filter(F.col("_i") < F.col("_size") * blocks).withColumn("block", F.floor(F.col("_i") / F.col("_size")))
    else:
        d = d.withColumn("block", F.floor(F.col("_i") * blocks / F.col("_t")))
        d = d.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy("block")))
    return d.select("date", F.col("block").cast("int").alias("block")), d.select(F.col("block").cast("int").alias("block"), "_size").distinct()


def block_moments(returns: DataFrame, blocks: int, keys: Sequence[str] = (), drop_tail: bool = True) -> DataFrame:
    """One row per strategy with its block moments (block, n, mean, m2); a missing day is a zero return."""
    dates, sizes = block_of_dates(returns, blocks, drop_tail)
    m = returns.join(F.broadcast(dates), "date").groupBy(*keys, "strategy_id", "block").agg(
        F.count("ret").alias("_k"), F.avg("ret").alias("_mu"), (F.coalesce(F.var_pop("ret"), F.lit(0.0)) * F.count("ret")).alias("_m2"))
    m = m.join(F.broadcast(sizes), "block")
    k, t, mu = F.col("_k"), F.col("_size"), F.coalesce("_mu", F.lit(0.0))
    m = m.select(*keys, "strategy_id", F.struct("block", t.cast("double").alias("n"), (mu * k / t).alias("mean"), (F.col("_m2") + k * (t - k) / t * mu * mu).alias("m2")).alias("s"))
    return m.groupBy(*keys, "strategy_id").agg(F.collect_list("s").alias("blocks"))  # at most one entry per block


def _scores(rows: pd.DataFrame, masks: np.ndarray, mode: str, sides: tuple[bool, ...] = (True, False)) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Scores (strategies × splits) on the in-sample (True) and out-of-sample (False) side, in small chunks.

    Block moments merge by three small matrix products around each strategy's own mean.  Scores are
    rounded to ten digits, so strategies that only differ by a scale factor tie exactly.
    """
    blocks = masks.shape[1]
    for lo in range(0, len(rows), 32):
        part = rows.iloc[lo:lo + 32]
        n, mean, m2 = np.zeros((len(part), blocks)), np.zeros((len(part), blocks)), np.zeros((len(part), blocks))
        for i, cells in enumerate(part["blocks"]):
            for c in cells:
                n[i, c["block"]], mean[i, c["block"]], m2[i, c["block"]] = c["n"], c["mean"], c["m2"]
        center = mean.mean(axis=1, keepdims=True)
        d = mean - center
        out = []
        for inside in sides:
            on = (masks if inside else ~masks).astype(float).T
            if mode == "mean":
                out.append(np.round(mean @ on / on.sum(axis=0), 12))
                continue
            cnt, avg, ss = n @ on, (n * d) @ on, (m2 + n * d * d) @ on
            with np.errstate(divide="ignore", invalid="ignore"):
                avg /= cnt
                ss -= cnt * avg * avg
                ss /= cnt - 1.0
                sr = np.where(ss > 1e-30, (avg + center) / np.sqrt(np.maximum(ss, 1e-300)) * YEAR, 0.0)
            out.append(np.round(np.nan_to_num(sr, nan=0.0, posinf=0.0, neginf=0.0), 10))
        yield part, out


def split_ranks(moments: DataFrame, blocks: int, mode: str = "sharpe", keys: Sequence[str] = (), max_splits: int | None = None) -> DataFrame:
    """Per split: the in-sample winner, its out-of-sample score and how many strategies score below, above and equal.

    Two passes over the strategy rows.  Each task folds its rows into one row per (group, split); the
    winners of the first pass, an array bounded by the split list, meet the buckets of strategies in the
    second.  Ties go to the smaller strategy id.
    """
    key_cols = list(keys)
    m = moments.withColumn("_g", F.concat_ws("|", *[F.col(k).cast("string") for k in key_cols]) if key_cols else F.lit(""))
    m = spread(m, "_g", "strategy_id")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = split_masks(blocks, max_splits)
        found: dict[str, list[np.ndarray]] = {}
        for rows in batches:
            for g, grp in rows.groupby("_g", sort=False):
                for part, (ins, oos) in _scores(grp, masks, mode):
                    ids = part["strategy_id"].to_numpy(dtype=object)
                    order = np.argsort(ids, kind="stable")
                    pick = order[np.argmax(ins[order], axis=0)]
                    at = np.arange(ins.shape[1])
                    new = [ins[pick, at], ids[pick], oos[pick, at]]
                    old = found.get(g)
                    if old is None:
                        found[g] = new
                    else:
                        take = (new[0] > old[0]) | ((new[0] == old[0]) & (new[1] < old[1]))
                        found[g] = [np.where(take, a, b) for a, b in zip(new, old)]
        for g, (s, i, o) in found.items():
            yield pd.DataFrame({"_g": g, "split": np.arange(len(s)), "neg_is": -s, "strategy_id": i, "oos": o})

    winners = (m.select("_g", "strategy_id", "blocks").mapInPandas(best, "_g string, split long, neg_is double, strategy_id string, oos double")
               .groupBy("_g", "split").agg(F.min(F.struct("neg_is", "strategy_id", "oos")).alias("w"))
               .groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("split", F.col("w.strategy_id").alias("star"), F.col("w.oos").alias("oos")))).alias("stars")))

    def place(rows: pd.DataFrame, win: pd.DataFrame) -> pd.DataFrame:
        names = ["_g", "split", "less", "more", "equal_before", "n"]
        if rows.empty or win.empty:
            return pd.DataFrame(columns=names)
        masks, stars = split_masks(blocks, max_splits), win["stars"].iloc[0]
        star_id, star_oos = np.array([s["star"] for s in stars], dtype=object), np.array([s["oos"] for s in stars], dtype=float)
        acc: list[np.ndarray] | None = None
        for part, (oos,) in _scores(rows, masks, mode, (False,)):
            ids = part["strategy_id"].to_numpy(dtype=object)
            level = oos == star_oos
            at, split = np.nonzero(level)
            tie = np.zeros(len(stars), dtype=int)
            np.add.at(tie, split, ids[at] < star_id[split])
            counts = [(oos < star_oos).sum(0), (oos > star_oos).sum(0), tie, np.full(len(stars), len(part))]
            acc = counts if acc is None else [x + y for x, y in zip(acc, counts)]
        return pd.DataFrame({"_g": rows["_g"].iloc[0], "split": np.arange(len(stars)), "less": acc[0], "more": acc[1], "equal_before": acc[2], "n": acc[3]})

    # the list of winners goes once to every bucket of strategies, not to every strategy
    buckets = 4 * moments.sparkSession.sparkContext.defaultParallelism
    left = m.select("_g", "strategy_id", "blocks", F.pmod(F.xxhash64("strategy_id"), F.lit(buckets)).cast("int").alias("_b"))
    right = winners.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    counted = (left.groupBy("_g", "_b").cogroup(right.groupBy("_g", "_b")).applyInPandas(place, "_g string, split long, less long, more long, equal_before long, n long")
               .groupBy("_g", "split").agg(*[F.sum(c).alias(c) for c in ("less", "more", "equal_before", "n")]))
    star = winners.select("_g", F.explode("stars").alias("s")).select("_g", "s.split", F.col("s.star").alias("star"), F.col("s.oos").alias("star_oos"))
    return counted.join(star, ["_g", "split"]).withColumnRenamed("_g", "grp")


def pbo(returns: DataFrame, blocks: int = 16, keys: Sequence[str] = (), max_splits: int | None = None) -> DataFrame:
    """Probability of back-test overfitting by combinatorially symmetric cross-validation, per group.

    ω = r / (S+1) with r = 1 + strategies below the winner; PBO is the share of splits with logit ≤ 0,
    the failure rate the share where the winner's out-of-sample Sharpe is negative.  All splits count unless ``max_splits`` asks for a
    sample; the output has their number.  Blocks must be even in number and hold at least ``MIN_BLOCK_ROWS`` dates.
    """
    dates = returns.select("date").distinct().count()
    if dates // blocks < MIN_BLOCK_ROWS:
        raise ValueError(f"{dates} dates give blocks of {dates // blocks}; at least {MIN_BLOCK_ROWS} are needed")
    r = split_ranks(block_moments(returns, blocks, keys), blocks, "sharpe", keys, max_splits)
    omega = (F.col("less") + 1.0) / (F.col("n") + 1.0)
    r = r.withColumn("logit", F.log(omega / (1.0 - omega)))
    return r.groupBy("grp").agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.percentile("logit", F.lit(0.5)).alias("median_logit"),
                                F.avg((F.col("star_oos") < 0).cast("double")).alias("failure_rate"), F.count(F.lit(1)).alias("n_splits"), F.max("n").alias("n_strategies"))


def pbo_on_means(returns: DataFrame, blocks: int = 8, keys: Sequence[str] = (), drop_tail: bool = False) -> DataFrame:
    """Variant on block means: percentile rank of the winner, logit below 0, and a verdict bucket."""
    r = split_ranks(block_moments(returns, blocks, keys, drop_tail), blocks, "mean", keys)
    pct = 1.0 - (F.col("more") + F.col("equal_before")) / F.greatest(F.col("n") - 1, F.lit(1))
    c = F.least(F.greatest(pct, F.lit(1e-9)), F.lit(1 - 1e-9))
    out = r.withColumn("logit", F.log(c / (1.0 - c))).groupBy("grp").agg(F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.avg(pct).alias("mean_percentile"),
                                                                        F.count(F.lit(1)).alias("n_splits"), F.max("n").alias("n_strategies"))
    p = F.col("pbo")
    return out.withColumn("bucket", F.when(p < 0.10, "strong").when(p < 0.25, "acceptable_but_cautious").when(p < 0.50, "fragile").otherwise("reject"))


def pbo_tiers(returns: DataFrame, blocks: int, tiers: dict[str, str | None], min_members: int = 3) -> DataFrame:
    """PBO for all strategies, per profile and per family in one plan: the tier label is just a group key."""
    parts = [returns.select("date", "strategy_id", "ret", F.lit(t).alias("tier"), (F.col(c).cast("string") if c else F.lit("all")).alias("member")) for t, c in tiers.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    out = pbo(long, blocks, ["tier", "member"]).filter(F.col("n_strategies") >= min_members)
    return out.select(F.split("grp", r"\|")[0].alias("tier"), F.split("grp", r"\|")[1].alias("member"), "pbo", "median_logit", "failure_rate", "n_splits", "n_strategies")


def partitions_for(n_dates: int, least: int = 5) -> int | None:
    """Largest of 8, 6, 4, 2 partitions with enough rows each."""
    return next((p for p in (8, 6, 4, 2) if n_dates // p >= least), None)


# ---------------------------------------------------------------- deflated Sharpe

def return_moments(returns: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """n, mean, sample deviation, annual Sharpe, and skew and kurtosis over the sample deviation."""
    n = F.count("ret")
    shrink = (n - 1) / n
    d = returns.groupBy(*keys).agg(n.alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), (F.skewness("ret") * F.pow(shrink, 1.5)).alias("skew"),
                                   ((F.kurtosis("ret") + 3.0) * F.pow(shrink, 2)).alias("kurt"))
    sr = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce(div("mean", "sd"), F.lit(0.0)))
    return d.withColumn("daily_sharpe", sr).withColumn("sharpe", sr * YEAR).withColumn("skew", F.coalesce(F.nanvl("skew", F.lit(0.0)), F.lit(0.0))).withColumn(
        "kurt", F.coalesce(F.nanvl("kurt", F.lit(3.0)), F.lit(3.0)))


def expected_max_z(trials: Column) -> Column:
    return (1.0 - EULER) * norm_ppf(1.0 - 1.0 / trials) + EULER * norm_ppf(1.0 - 1.0 / (trials * math.e))


def _denominator() -> Column:
    s = F.col("daily_sharpe")
    return F.sqrt(F.greatest(1.0 - F.col("skew") * s + (F.col("kurt") - 1.0) / 4.0 * s * s, F.lit(1e-12)))


def deflated_sharpe(moments: DataFrame) -> DataFrame:
    """Probabilistic and deflated Sharpe of every strategy against the expected maximum of all trials."""
    pool = moments.agg(F.count(F.lit(1)).cast("double").alias("trials"), F.var_samp("daily_sharpe").alias("sr_var"))
    pool = pool.withColumn("e_max", F.when((F.col("trials") > 1) & (F.col("sr_var") > 0), F.sqrt("sr_var") * expected_max_z(F.col("trials"))).otherwise(0.0))
    d = moments.crossJoin(F.broadcast(pool)).withColumn("_den", _denominator())  # one-row side
    root = F.sqrt(F.col("n") - 1.0)
    d = d.withColumns({"_z0": F.col("daily_sharpe") * root / F.col("_den"), "_z1": (F.col("daily_sharpe") - F.col("e_max")) * root / F.col("_den")})
    short, flat = F.col("n") < 4, F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    positive = (F.col("mean") > 0).cast("double")
    return d.withColumns({"psr_zero": F.when(short, 0.5).when(flat, positive).otherwise(norm_cdf("_z0")), "dsr": F.when(short, 0.5).when(flat, positive).otherwise(norm_cdf("_z1")),
                          "expected_max_sharpe": F.col("e_max") * YEAR}).drop("_den", "_z0", "_z1", "sr_var", "e_max")


def deflated_sharpe_by_count(moments: DataFrame, trials: int) -> DataFrame:
    """The approximation with benchmark E[max z] / sqrt(n-1)."""
    k = float(max(2, trials))
    m = moments.filter((F.col("n") >= 5) & (F.col("sd") > 0))
    bench = F.lit(0.0) if trials <= 1 else F.greatest(expected_max_z(F.lit(k)) / F.sqrt(F.col("n") - 1.0), F.lit(0.0))
    d = m.withColumn("benchmark", bench).withColumn("_den", _denominator())
    d = d.withColumn("z_score", (F.col("daily_sharpe") - F.col("benchmark")) * F.sqrt(F.col("n") - 1.0) / F.col("_den"))
    return d.withColumn("probability", norm_cdf("z_score")).withColumn("benchmark_annual_sharpe", F.col("benchmark") * YEAR).drop("_den", "benchmark")


def multiple_testing(moments: DataFrame) -> DataFrame:
    """One-sided p-value, Bonferroni bound and expected noise maximum of the best strategy."""
    d = moments.agg(F.max_by(F.struct("strategy_id", "sharpe", "n"), F.struct("sharpe", "strategy_id")).alias("b"), F.count(F.lit(1)).cast("double").alias("trials")).select("b.*", "trials")
    p = F.when(F.col("n") <= 1, 1.0).otherwise(1.0 - norm_cdf(F.col("sharpe") * F.sqrt(F.col("n") / 365.0)))
    d = d.withColumn("raw_p", p).withColumn("bonferroni_p", F.least(F.lit(1.0), F.col("raw_p") * F.greatest("trials", F.lit(1.0))))
    d = d.withColumn("expected_max_noise_z", norm_ppf(1.0 - 1.0 / F.greatest("trials", F.lit(2.0))))
    return d.withColumn("deflated_sharpe_proxy", F.col("sharpe") - F.col("expected_max_noise_z"))


def expected_against_best(moments: DataFrame, tiers: Sequence[int]) -> DataFrame:
    """Best Sharpe among the first n strategies (by id) against its expectation, per tier."""
    from quantloom.operators.ranks import ordinal
    r = ordinal(moments.withColumn("_one", F.lit(0)).withColumn("_v", F.lit(0.0)), "_v", "_i", ("_one",), ("strategy_id",))
    pool = moments.agg(F.var_samp("sharpe").alias("var"), F.count(F.lit(1)).alias("total"))
    t = r.select("_i", "sharpe", F.explode(F.array(*[F.lit(x) for x in tiers])).alias("tier")).crossJoin(F.broadcast(pool)).withColumn("n_trials", F.least("tier", "total"))  # one-row side
    out = t.filter(F.col("_i") <= F.col("n_trials")).groupBy("tier", "n_trials", "var").agg(F.max("sharpe").alias("empirical_max"))
    return out.withColumn("theoretical_max", F.when(F.col("n_trials") > 1, F.sqrt("var") * expected_max_z(F.col("n_trials").cast("double"))).otherwise(0.0)).drop("var")


# ---------------------------------------------------------------- resampling

def return_arrays(returns: DataFrame, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """One calendar-bounded array of returns in date order per strategy."""
    return returns.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda s: s["ret"]).alias("rets"))


Blocks = Callable[[int, int, int, int, np.ndarray], tuple[np.ndarray, np.ndarray]]


def circular_blocks(key: int, t: int, length: int, chunk: int, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of fixed circular blocks, one row per resample; the last block is cut."""
    blocks = -(-t // length)
    b = np.arange(blocks)
    start = np.floor(counter_uniform(key, draws[:, None] * blocks + b[None, :]) * t).astype(np.int64)
    return start, np.broadcast_to(np.minimum(length, t - b * length), start.shape)


def geometric_blocks(key: int, t: int, length: int, chunk: int, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of blocks of geometric length, one row per resample, until ``t`` rows are filled."""
    rng = np.random.Generator(np.random.SFC64([key, chunk]))
    scale = 1.0 / math.log1p(-1.0 / length) if length > 1 else 0.0

    def drawn(n: int) -> tuple[np.ndarray, np.ndarray]:  # of 64 random bits the upper half gives the start, the lower the length by inversion
        bits = rng.integers(0, 1 << 64, (len(draws), n), dtype=np.uint64)
        low = (bits & np.uint64(0xFFFFFFFF)).astype(np.float64)
        low += 0.5
        low *= 2.0 ** -32
        np.log(low, out=low)
        low *= scale
        return (((bits >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).view(np.int64), low.astype(np.int64) + 1

    mean = t / length
    start, size = drawn(int(mean + 3.0 * math.sqrt(mean)) + 2)
    while size.sum(axis=1).min() < t:
        start, size = (np.concatenate(x, axis=1) for x in zip((start, size), drawn(int(math.sqrt(mean)) + 2)))
    filled = np.minimum(np.cumsum(size, axis=1), t)
    size = filled.copy()
    size[:, 1:] -= filled[:, :-1]
    return start, size


def resampled_sharpes(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Annual Sharpe of each resample from running sums: a block costs two look-ups however long it is."""
    t, center = len(x), x.mean()
    y = np.concatenate([x, x]) - center  # a block wraps at most once
    s1, s2 = (np.append(0.0, np.cumsum(v)) for v in (y, y * y))
    end = start + size
    a, b = ((s[end] - s[start]).sum(axis=1) for s in (s1, s2))
    var = np.maximum(b - a * a / t, 0.0) / max(1, t - 1)
    flat = var <= 1e-12 * max(s2[t] / t, np.finfo(float).tiny)  # only rounding is left
    return np.where(flat, 0.0, (a / t + center) / np.sqrt(np.where(flat, 1.0, var)) * YEAR)


def bootstrap(returns: DataFrame, blocks: Blocks, resamples: int, block: int | None, seed: int, least: int, per_task: int = 1000) -> DataFrame:
    """Sharpe interval per strategy by resampled blocks of its returns; non-finite returns go.

    A strategy is one array in one row; its task draws the resamples ``per_task`` at a time and gives back the two bounds, so neither the returns nor the resamples
    are shuffled once more.  A draw depends only on (seed, strategy, resample or chunk), so a repeated task gives the same numbers.  Strategies with fewer than
    ``least`` returns have the status ``not_enough_observations``, zero bounds and no resamples.
    """
    if resamples <= 0:
        raise ValueError("resamples must be positive")
    finite = returns.filter(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf")))
    arrays = returns.select("strategy_id").distinct().join(return_arrays(finite), "strategy_id", "left").withColumn("rets", F.coalesce("rets", F.array().cast("array<double>")))
    chunks = [(c, np.arange(first, min(resamples, first + per_task))) for c, first in enumerate(range(0, resamples, per_task))]

    def interval(key: int, rets: np.ndarray) -> tuple:
        x = np.asarray(rets, dtype=float)
        t = len(x)
        length = block or max(1, round(t ** (1 / 3)))
        point = 0.0 if t < 2 or (x == x[0]).all() else x.mean() / x.std(ddof=1) * YEAR
        if t < least:
            return "not_enough_observations", point, 0.0, 0.0, 0, t, length
        sharpes = np.concatenate([resampled_sharpes(x, *blocks(int(key), t, length, c, draws)) for c, draws in chunks])
        return "computed", point, *linear_quantiles(sharpes, (0.025, 0.975)), resamples, t, length

    columns = ["status", "point_sharpe", "ci_lower_95", "ci_upper_95", "resamples", "observations", "block_length"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame([interval(k, x) for k, x in zip(rows["key"], rows["rets"])], columns=columns)
            out.insert(0, "strategy_id", rows["strategy_id"].to_numpy())
            yield out

    kind = "strategy_id string, status string, point_sharpe double, ci_lower_95 double, ci_upper_95 double, resamples long, observations long, block_length long"
    return spread(arrays.withColumn("key", key32("strategy_id", seed=seed)), "strategy_id").mapInPandas(draw, kind)


def linear_quantiles(x: np.ndarray, levels: Sequence[float]) -> list[float]:
    """Quantiles by linear interpolation, from a partial sort."""
    at = [p * (len(x) - 1) for p in levels]
    ranks = sorted({r for v in at for r in (math.floor(v), math.ceil(v))})
    part = np.partition(x, ranks)
    return [float(part[math.floor(v)] + (part[math.ceil(v)] - part[math.floor(v)]) * (v - math.floor(v))) for v in at]


def stationary_bootstrap(returns: DataFrame, resamples: int = 10_000, block: int | None = None, seed: int = 42) -> DataFrame:
    """Sharpe interval by blocks of geometric length (mean: cube root of the number of returns)."""
    return bootstrap(returns, geometric_blocks, resamples, block, seed, least=2)


def circular_bootstrap(returns: DataFrame, resamples: int = 1000, block: int | None = None, seed: int = 17) -> DataFrame:
    """Sharpe interval by fixed circular blocks (cube root of the number of returns)."""
    return bootstrap(returns, circular_blocks, resamples, block, seed, least=5)


def permuted_bars(bars: DataFrame, permutations: int, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """Bars whose daily returns and bar shapes are permuted together per symbol, the path rebuilt from the first close.

    Rows per (perm_id, symbol, date).  The permutation is the keyed-random order of the symbol's rows, met
    with their time order by an equi join; the first row keeps its place.
    """
    w = by()
    cols = ("open", "high", "low")
    d = bars.withColumns({"_i": F.row_number().over(w), "_lr": F.log("close") - F.log(F.lag("close").over(w)), **{f"_{c}": F.col(c) / F.col("close") for c in cols}})
    first = d.filter("_i = 1").select("symbol", F.col("close").alias("_c0"))
    src = d.withColumn("perm_id", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("_u", F.when(F.col("_i") == 1, F.lit(-1.0)).otherwise(uniform("symbol", "date", "perm_id", seed=seed)))
    src = src.withColumn("_slot", F.row_number().over(W.partitionBy("symbol", "perm_id").orderBy("_u", "date")))
    src = src.select("symbol", "perm_id", F.col("_slot").alias("_i"), "_lr", *[f"_{c}" for c in cols])
    at = d.select("symbol", "date", "volume", "_i", *keep)
    j = src.join(at, ["symbol", "_i"]).join(first, "symbol")
    path = F.sum(F.coalesce("_lr", F.lit(0.0))).over(W.partitionBy("symbol", "perm_id").orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    j = j.withColumn("close", F.col("_c0") * F.exp(path))
    return j.select("perm_id", "symbol", "date", *[(F.col("close") * F.col(f"_{c}")).alias(c) for c in cols], "close", "volume", *keep)


def permutation_p_value(best: DataFrame) -> DataFrame:
    """(# permuted best ≥ real best, plus one) over (n + 1); ``best`` has perm_id (-1 for the real run) and best_sharpe."""
    real = best.filter("perm_id = -1").select(F.col("best_sharpe").alias("real_best"))
    p = best.filter("perm_id >= 0").crossJoin(F.broadcast(real))  # one-row side
    return p.groupBy("real_best").agg(F.count(F.lit(1)).alias("n_permutations"), F.avg("best_sharpe").alias("permuted_mean"),
                                      ((F.count_if(F.col("best_sharpe") >= F.col("real_best")) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("p_value"))


# ---------------------------------------------------------------- correlation clusters

TILE_ROWS = 16384
OPEN_PAIRS = 1 << 16  # of one tile pair that are decided one by one


def correlation_edges(returns: DataFrame, threshold: float = 0.9, tile: int | None = None, open_pairs: int = OPEN_PAIRS) -> DataFrame:
    """Edges that span the |correlation| ≥ threshold graph: a spanning forest per tile pair, at most its rows less one.

    Strategies are standardised once and travel as single precision cells beside a bitmap of their dates.  A pair of tiles is one task; every strategy
    goes to as many tasks as there are tiles, so tiles are as large as a task holds (``TILE_ROWS``; two of them take 0.4 GB at 2500 dates),
    or as small as gives every core a pair.  Products are screened in single precision; pairs its error leaves open are decided in double precision
    in a second step, to which only they travel, or the whole tile pair where more than ``open_pairs`` are open.  Only spanning edges leave a task
    (never all pairs), so a large cluster of near-copies costs at most one edge per row and tile pair.
    """
    spark = returns.sparkSession
    dates = returns.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")) - 1)  # calendar-sized
    total = dates.agg(F.count(F.lit(1)).alias("_n"))
    arr = returns.join(F.broadcast(dates.crossJoin(total)), "date").groupBy("strategy_id").agg(F.collect_list(F.struct("_i", "ret")).alias("cells"), F.max("_n").alias("_n"))
    kind = dict(returns.dtypes)["strategy_id"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, at, ret, n in zip(pdf["strategy_id"], pdf["at"], pdf["ret"], pdf["_n"]):
                z, on = np.zeros(n), np.zeros(n, bool)
                z[at], on[at] = ret, True
                x = z[on]
                z -= z.mean()
                norm = np.sqrt((z * z).sum())
                z = z / norm if norm > 0 else np.zeros(n)
                out.append((key, np.packbits(on).tobytes(), x.tobytes(), z[on].astype(np.float32).tobytes(), float(z[~on][0]) if not on.all() else 0.0, n))
            yield pd.DataFrame(out, columns=["strategy_id", "at", "ret", "unit", "rest", "_n"])

    flat = arr.select("strategy_id", F.col("cells._i").alias("at"), F.col("cells.ret").alias("ret"), "_n")
    packed = stored(flat.mapInPandas(pack, f"strategy_id {kind}, at binary, ret binary, unit binary, rest double, _n long"))
    n, cores = packed.count(), spark.sparkContext.defaultParallelism
    if tile is None:
        tiles = max(math.ceil(n / TILE_ROWS), min(math.ceil(n / 256), math.ceil(math.sqrt(2 * cores))), 1)
    else:
        tiles = max(1, math.ceil(n / tile))
    # tiles by hash are near-even; the size only affects speed, every pair of strategies meets in one tile pair
    others = F.sequence(F.lit(0), F.lit(tiles - 1))

    def tiled(*columns: str) -> DataFrame:
        a = packed.select("strategy_id", "at", *columns, "_n", F.pmod(F.xxhash64("strategy_id"), F.lit(tiles)).cast("int").alias("_t"))
        return a.withColumn("_o", F.explode(others)).withColumn("_p", F.least("_t", "_o")).withColumn("_q", F.greatest("_t", "_o")).drop("_o")

    def dense(at: bytes, cells: np.ndarray, dates_: int, rest: float = 0.0) -> np.ndarray:
        z = np.full(dates_, rest, cells.dtype)
        z[np.unpackbits(np.frombuffer(at, np.uint8), count=dates_).view(bool)] = cells
        return z

    def standard(at: np.ndarray, ret: np.ndarray, dates_: int) -> np.ndarray:
        z = np.array([dense(a, np.frombuffer(r), dates_) for a, r in zip(at, ret)]).reshape(len(at), dates_)
        z -= z.mean(axis=1, keepdims=True)
        norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)

    def forest(pdf: pd.DataFrame, exact: bool) -> pd.DataFrame:
        p, q, dates_ = int(pdf["_p"].iloc[0]), int(pdf["_q"].iloc[0]), int(pdf["_n"].iloc[0])
        ids, t, ats = pdf["strategy_id"].to_numpy(dtype=object), pdf["_t"].to_numpy(), pdf["at"].to_numpy()
        left, right = np.where(t == p)[0], np.where(t == q)[0]

        def rows(at: np.ndarray) -> np.ndarray:
            if exact:
                return standard(ats[at], pdf["ret"].to_numpy()[at], dates_)
            units, rests, z = pdf["unit"].to_numpy(), pdf["rest"].to_numpy(), np.empty((len(at), dates_), np.float32)
            for k, r in enumerate(at):
                z[k] = dense(ats[r], np.frombuffer(units[r], np.float32), dates_, rests[r])
            return z

        # a spanning forest of the tile pair's hits: rows that an edge joined carry one label
        label, src, dst, open_ = np.arange(len(ids)), [], [], []

        def join(i: int, js: np.ndarray) -> None:
            other = label[js] != label[i]
            for old, k in zip(*np.unique(label[js[other]], return_index=True)):
                src.append(ids[i])
                dst.append(ids[js[other][k]])
                label[label == old] = label[i]

        screen = 1e-12 if exact else (dates_ + 8) * 2.0 ** -23  # bounds the error of a single precision product of unit vectors
        step = 2048 if exact else len(right)  # double precision takes a part of the right tile at a time
        for r in range(0, len(right), max(step, 1)):
            part = right[r:r + step]
            zr = rows(part)
            for k in range(0, len(left), 256):
                near = np.abs(rows(left[k:k + 256]) @ zr.T)
                for i, row in zip(left[k:k + 256], near):
                    join(i, part[row >= threshold + (-screen if exact else screen)])
                    if not exact and len(open_) <= open_pairs:
                        js = part[(row >= threshold - screen) & (row < threshold + screen)]
                        open_ += [(i, j) for j in js[label[js] != label[i]][:open_pairs + 1]]
        full = len(open_) > open_pairs
        late = [] if full else [(i, j) for i, j in open_ if label[i] != label[j]]
        n_open = len(late) + full
        return pd.DataFrame({"src": pd.Series(src + [ids[i] for i, _ in late] + [None] * full, dtype=object), "dst": pd.Series(dst + [ids[j] for _, j in late] + [None] * full, dtype=object),
                             "open": [False] * len(src) + [True] * n_open, "_p": p, "_q": q})

    parts = max(cores, min(2 * tiles * (tiles + 1), 4096))
    edge = f"src {kind}, dst {kind}, open boolean, _p int, _q int"

    def edges(a: DataFrame, exact: bool) -> DataFrame:
        return a.repartition(parts, "_p", "_q").groupBy("_p", "_q").applyInPandas(lambda pdf: forest(pdf, exact), edge)

    found = stored(edges(tiled("unit", "rest"), False).filter("open OR src <> dst"))
    sure = found.filter("NOT open").select("src", "dst").distinct()
    left_open = found.filter("open")
    if left_open.isEmpty():
        return sure

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = [abs(float((standard([a, c], [b, d], n)[0] * standard([a, c], [b, d], n)[1]).sum())) for a, b, c, d, n in zip(pdf["a"], pdf["b"], pdf["c"], pdf["d"], pdf["_n"])]
            yield pdf.loc[np.array(near, dtype=float) >= threshold - 1e-12, ["src", "dst"]]

    one = packed.select(F.col("strategy_id").alias("src"), F.col("at").alias("a"), F.col("ret").alias("b"), "_n")
    two = packed.select(F.col("strategy_id").alias("dst"), F.col("at").alias("c"), F.col("ret").alias("d"))
    single = left_open.filter("src IS NOT NULL").select("src", "dst").distinct().join(one, "src").join(two, "dst").mapInPandas(decide, f"src {kind}, dst {kind}")
    whole = left_open.filter("src IS NULL").select("_p", "_q")
    if not whole.isEmpty():
        single = single.unionByName(edges(tiled("ret").join(F.broadcast(whole), ["_p", "_q"], "left_semi"), True).select("src", "dst"))
    return sure.unionByName(single).filter("src <> dst").distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Connected components by minimum labels with pointer jumping; every round is checkpointed reliably.

    Runs until labels rest; a given ``max_rounds`` that is too small raises.
    """
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = durable(both)
    labels = durable(nodes.select(F.col("strategy_id").alias("id"), F.col("strategy_id").alias("label")))
    for k in itertools.count():
        if k == max_rounds:
            raise RuntimeError(f"components still change after {max_rounds} rounds")
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        step = durable(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        changed = step.filter("old <> label").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            break
    return labels.select(F.col("id").alias("strategy_id"), F.col("label").alias("cluster"))


def representatives(clusters: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per cluster: best Sharpe per root turnover, best deflated Sharpe, lowest drawdown (as the metric defines it); ties to the smaller id."""
    d = clusters.join(metrics, "strategy_id").withColumn("_q", F.col("sharpe") / F.sqrt(F.greatest("turnover", F.lit(1e-6))))
    low = lambda x: F.min(F.struct(x.alias("v"), F.col("strategy_id")))["strategy_id"]
    return d.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"), low(-F.col("_q")).alias("by_sharpe_per_sqrt_turnover"), low(-F.col("dsr")).alias("by_dsr"), low(F.col("drawdown")).alias("by_lowest_drawdown"))


# ---------------------------------------------------------------- selection and gates

def pareto_front(metrics: DataFrame, maximise: str, minimise: Sequence[str], tile: int = 2048, guards: int = 16) -> DataFrame:
    """Strategies no other one dominates.  Equal points do not dominate each other; a point with a NaN neither dominates nor is dominated.

    Rows are range partitioned from the best to the worst first axis, so a row is dominated only from its own range or a better one.
    Every range keeps its local front; then the running skyline of the better ranges, made of the ``guards`` rows of each with the least
    sum of ranks, takes out what it dominates.  If more than ``tile`` rows are left, they are cut into ranges of about that size again and
    a range meets a better one only where the corners of the two allow a dominated row.
    """
    cols = [maximise, *minimise]
    sign_ = np.array([-1.0] + [1.0] * len(minimise))
    best_first = [F.col(maximise).desc(), *[F.col(c).asc() for c in minimise], F.col("strategy_id").asc()]

    def values(pdf: pd.DataFrame) -> np.ndarray:
        return pdf[cols].to_numpy(dtype=float) * sign_

    def beaten(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.fromiter((((by <= x).all(1) & (by < x).any(1)).any() for x in v), bool, len(v))

    def front(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            cand = pdf if best is None else pd.concat([best, pdf])
            v = values(cand)
            keep: list[int] = []
            for i in np.lexsort(v.T[::-1]):
                if not keep or not ((v[keep] <= v[i]).all(1) & (v[keep] < v[i]).any(1)).any():
                    keep.append(i)
            best = cand.iloc[keep]
        if best is not None:
            yield best

    def ranged(d: DataFrame, parts: int | None) -> DataFrame:
        d = d.repartitionByRange(parts, *best_first) if parts else d.repartitionByRange(*best_first)
        return durable(d.mapInPandas(front, metrics.schema).withColumn("_b", F.spark_partition_id()))

    local = ranged(metrics, None)
    rank = sum((F.percent_rank().over(W.partitionBy("_b").orderBy(o)) for o in best_first[1:-1]), F.percent_rank().over(W.partitionBy("_b").orderBy(best_first[0])))
    strong = local.withColumn("_r", rank).withColumn("_n", F.row_number().over(W.partitionBy("_b").orderBy("_r", "strategy_id"))).filter(F.col("_n") <= guards)
    skyline = np.array([[float("nan") if x is None else x for x in r] for r in strong.select(*[F.col(c).cast("double") for c in cols]).collect()]).reshape(-1, len(cols)) * sign_  # guards rows a range
    skyline = skyline[~beaten(skyline, skyline)]

    def guarded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[~beaten(values(pdf), skyline)]

    left = durable(local.drop("_b").mapInPandas(guarded, metrics.schema))
    n = left.count()
    if n <= tile:
        return left.repartition(1).mapInPandas(front, metrics.schema)
    blocks = ranged(left, math.ceil(n / tile))
    corner = blocks.groupBy("_b").agg(*[f(F.col(c) * s).alias(f"{p}{i}") for i, (c, s) in enumerate(zip(cols, sign_.tolist())) for p, f in (("lo", F.min), ("hi", F.max))])
    better = corner.select(F.col("_b").alias("_p"), *[F.col(f"lo{i}").alias(f"low{i}") for i in range(len(cols))])
    worse = corner.select(F.col("_b").alias("_q"), *[F.col(f"hi{i}") for i in range(len(cols))])
    meets = F.col("_p") < F.col("_q")
    for i in range(len(cols)):
        meets &= F.col(f"low{i}") <= F.col(f"hi{i}")
    pairs = durable(better.join(worse, meets).select("_p", "_q"))  # one row per range on either side

    def dominated(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["_side"].to_numpy()
        v = values(pdf)
        low = pdf[["strategy_id"]][side == 1]
        return low[beaten(v[side == 1], v[side == 0])]

    both = blocks.join(pairs, blocks["_b"] == pairs["_p"]).withColumn("_side", F.lit(0)).unionByName(blocks.join(pairs, blocks["_b"] == pairs["_q"]).withColumn("_side", F.lit(1)))
    id_type = metrics.schema["strategy_id"].dataType.simpleString()
    lost = both.groupBy("_p", "_q").applyInPandas(dominated, f"strategy_id {id_type}").distinct()
    return blocks.drop("_b").join(lost, "strategy_id", "left_anti")


def gate_table(metrics: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "blockers") -> DataFrame:
    """Evaluate named rules on every metrics row: failed rule names as an array, and the pass flag."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules]))
    return metrics.withColumn(name, failed).withColumn("passed", F.size(name) == 0)


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Row count of every selection stage."""
    out = None
    for i, (name, d) in enumerate(stages):
        c = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def dev_threshold(df: DataFrame, prediction: str, dev: Column, quantile: float) -> DataFrame:
    """Threshold column from the development quantile of |prediction|."""
    q = exact_quantiles(df, F.when(dev, F.abs(prediction)), [quantile]).select(F.col("q")[0].alias("threshold"))
    return df.crossJoin(F.broadcast(q))  # one-row side


def grid_sharpes(returns: DataFrame, oos_fraction: float = 0.3, embargo: int = 10, keys: Sequence[str] = ("strategy_id",)) -> DataFrame:
    """In- and out-of-sample Sharpe per strategy with an embargo after the split; missing days are zero returns."""
    dates = returns.select("date").distinct().withColumn("_i", F.row_number().over(W.orderBy("date")) - 1)  # calendar-sized
    t = dates.agg(F.count(F.lit(1)).alias("_t"))
    dates = dates.crossJoin(F.broadcast(t)).withColumn("_cut", F.floor(F.col("_t") * (1.0 - oos_fraction)))  # one-row side
    d = returns.join(F.broadcast(dates), "date")
    ins, oos = F.col("_i") < F.col("_cut"), F.col("_i") >= F.least(F.col("_cut") + embargo, F.col("_t"))
    n_is, n_oos = F.max("_cut"), F.max(F.col("_t") - F.least(F.col("_cut") + embargo, F.col("_t")))

    def sr(side: Column, size: Column) -> Column:
        x = F.when(side, F.col("ret"))
        mean = F.coalesce(F.sum(x), F.lit(0.0)) / size
        k = F.count(x)
        m2 = F.coalesce(F.var_pop(x), F.lit(0.0)) * k + F.coalesce(F.avg(x) * F.avg(x), F.lit(0.0)) * k * (size - k) / size
        return F.coalesce(div(mean, F.sqrt(m2 / (size - 1))), F.lit(0.0)) * YEAR

    return d.groupBy(*keys).agg(sr(ins, n_is).alias("is_sharpe"), sr(oos, n_oos).alias("oos_sharpe"))
