"""Models over fold tables: exact ridge and stacking from Gram matrices, MLlib learners, regime states.

Linear models need only the k × k Gram matrix of the features.  Tasks accumulate one matrix per training
segment (dates that belong to the same set of folds), so a row is read once however many expanding
folds contain it; the driver only ever sees a few k × k matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import div, zero_fill
from quantloom.operators import metrics as mt
from quantloom.operators.ranks import value_bin
from quantloom.session import durable, spread

MAX_GRAM_FEATURES = 2000


# ---------------------------------------------------------------- Gram matrices and ridge

def grams(rows: DataFrame, features: Sequence[str], target: str, key: str) -> dict[object, np.ndarray]:
    """Gram matrix of [1, features, target] per value of ``key`` (a bounded set of segments)."""
    if len(features) > MAX_GRAM_FEATURES:
        raise ValueError("too many features for one Gram matrix")
    cols = [*features, target]
    k = len(cols) + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[object, np.ndarray] = {}
        for pdf in batches:
            for g, d in pdf.groupby("_g", sort=False):
                x = np.column_stack([np.ones(len(d)), d[cols].to_numpy(dtype=float)])
                acc[g] = acc.get(g, 0.0) + x.T @ x
        for g, m in acc.items():
            yield pd.DataFrame({"_g": [g], "m": [m.ravel().tolist()]})

    d = rows.select(F.col(key).cast("string").alias("_g"), *[zero_fill(c).alias(c) for c in cols]).mapInPandas(part, "_g string, m array<double>")
    cells = d.select("_g", F.posexplode("m").alias("i", "v")).groupBy("_g", "i").agg(F.sum("v").alias("v")).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m"))
    return {r["_g"]: np.array([c["v"] for c in r["m"]]).reshape(k, k) for r in cells.collect()}


def solve_ridge(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients on the raw scale of a standardised ridge fit."""
    n, m = gram[0, 0], gram[0] / gram[0, 0]
    cov = gram / n - np.outer(m, m)
    s = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0.0))
    s = np.where(s > 1e-12, s, 1.0)
    a = cov[1:-1, 1:-1] / np.outer(s, s) * n + alpha * np.eye(len(s))
    b = cov[1:-1, -1] / s * n
    w = np.linalg.solve(a, b) / s
    return float(m[-1] - w @ m[1:-1]), w


def fold_grams(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, date: str = "date", role: str = "train") -> dict[int, np.ndarray]:
    """Train Gram matrix of every fold from disjoint date segments."""
    sig = folds.filter(F.col("role") == role).groupBy(date).agg(F.concat_ws(",", F.array_sort(F.collect_list(F.col("fold").cast("string")))).alias("_seg"))
    parts = grams(rows.join(F.broadcast(sig), date), features, target, "_seg")
    out: dict[int, np.ndarray] = {}
    for seg, m in parts.items():
        for f in seg.split(","):
            out[int(f)] = out.get(int(f), 0.0) + m
    return out


def linear_prediction(features: Sequence[str], intercept: Column, coef: Column) -> Column:
    out = intercept
    for i, c in enumerate(features):
        out = out + F.get(coef, i) * zero_fill(c)
    return out


def ridge_walk_forward(rows: DataFrame, folds: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, date: str = "date", test_role: str = "test") -> DataFrame:
    """Out-of-fold ridge predictions: one pass for the Gram matrices, one for the test rows."""
    fits = {f: solve_ridge(m, alpha) for f, m in fold_grams(rows, folds, features, target, date).items()}
    spark = rows.sparkSession
    coefs = spark.createDataFrame([(f, i, [float(x) for x in w]) for f, (i, w) in sorted(fits.items())], "fold INT, _b DOUBLE, _w ARRAY<DOUBLE>")
    test = folds.filter(F.col("role") == test_role).select(date, F.col("fold").cast("int").alias("fold"))
    d = rows.join(F.broadcast(test), date).join(F.broadcast(coefs), "fold")
    return d.withColumn("prediction", linear_prediction(features, F.col("_b"), F.col("_w"))).drop("_b", "_w")


def nnls(gram: np.ndarray, xty: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares of a small normal system by coordinate descent."""
    w = np.zeros(len(xty))
    for _ in range(rounds):
        before = w.copy()
        for i in range(len(w)):
            if gram[i, i] > 0:
                w[i] = max(0.0, w[i] + (xty[i] - gram[i] @ w) / gram[i, i])
        if np.abs(w - before).max() < 1e-14:
            break
    return w


def stack_weights(oof: DataFrame, models: Sequence[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Non-negative ridge weights of out-of-fold columns, scaled to sum 1 (equal when all vanish), and the residual scale."""
    g = grams(oof.withColumn("_all", F.lit("all")), models, target, "_all")["all"]
    n = g[0, 0]
    w = nnls(g[1:-1, 1:-1] + alpha * np.eye(len(models)), g[1:-1, -1])
    w = w / w.sum() if w.sum() > 0 else np.full(len(models), 1.0 / len(models))
    v = np.concatenate([w, [-1.0]])
    scale = math.sqrt(max(v @ g[1:, 1:] @ v / n, 0.0))
    return {**dict(zip(models, map(float, w))), "residual_scale": scale}


def stacked(df: DataFrame, weights: dict[str, float], name: str = "stacked") -> DataFrame:
    """Stacked prediction and its confidence |p| / (|p| + residual scale)."""
    p = sum((F.lit(w) * zero_fill(m) for m, w in weights.items() if m != "residual_scale"), F.lit(0.0))
    d = df.withColumn(name, p)
    return d.withColumn("confidence", F.coalesce(div(F.abs(name), F.abs(name) + weights["residual_scale"]), F.lit(0.0)))


def active_models(oof: DataFrame, models: Sequence[str], target: str, weight: str, min_r2: float = 0.0) -> list[str]:
    """Models whose out-of-fold R² is above a floor; the best one if none is."""
    row = oof.agg(*[mt.zero_mean_r2(target, m, weight).alias(m) for m in models]).first()
    good = [m for m in models if row[m] > min_r2]
    return good or [max(models, key=lambda m: row[m])]


def average_ensemble(df: DataFrame, models: Sequence[str], name: str = "average") -> DataFrame:
    return df.withColumn(name, sum((zero_fill(m) for m in models), F.lit(0.0)) / float(len(models)))


# ---------------------------------------------------------------- feature screening

def univariate_auc(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Train-against-holdout AUC of every feature from mid-ranks (Mann-Whitney), all features in one job.

    Rows are first counted per (feature, value), so a value that fills a third of the table is one row; the
    distinct values are then ranked bin by bin.  Equal values share their mean rank.
    """
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), zero_fill(c).alias("x")) for c in features])).alias("s")).select(label, "s.*")
    v = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).withColumn("_bin", value_bin("x"))
    sizes = v.groupBy("feature", "_bin").agg(F.sum("n").alias("_n"))
    below = W.partitionBy("feature").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    off = sizes.select("feature", "_bin", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("feature", "_bin").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = v.withColumn("_in", before).join(off, ["feature", "_bin"]).withColumn("_rank", F.col("_off") + F.col("_in") + (F.col("n") + 1) / 2.0)
    s = r.groupBy("feature").agg(F.sum(F.col("_rank") * F.col("p")).alias("rank_sum"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    auc = div(F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))
    return s.withColumn("auc", F.greatest(auc, 1.0 - auc)).select("feature", "auc").withColumn("drop", F.col("auc") >= 0.6)


def below_noise_floor(importances: Sequence[tuple[str, float]], noise: str = "noise") -> list[str]:
    floor = dict(importances)[noise]
    return [n for n, v in importances if n != noise and v <= floor]


# ---------------------------------------------------------------- MLlib learners

def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def clean(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_fill(c) for c in features})


def linear_model(kind: str, target: str, reg: float = 1e-3, l1: float = 0.5) -> Pipeline:
    lr = {"elastic_net": lambda: LinearRegression(labelCol=target, regParam=reg, elasticNetParam=l1, maxIter=50), "ridge": lambda: LinearRegression(labelCol=target, regParam=reg, elasticNetParam=0.0),
          "huber": lambda: LinearRegression(labelCol=target, loss="huber", regParam=reg, maxIter=50)}[kind]()
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True), lr.setFeaturesCol("_scaled")])


def boosted_trees(target: str, trees: int = 10, depth: int = 3, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)


def forest_classifier(label: str, trees: int = 20, depth: int = 4, seed: int = 42, weight: str | None = None) -> RandomForestClassifier:
    m = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    return m.setWeightCol(weight) if weight else m


def walk_forward_model(rows: DataFrame, folds: DataFrame, features: Sequence[str], estimator, date: str = "date", test_role: str = "test", probability: bool = False) -> DataFrame:
    """Fit one MLlib model per fold on its train dates and score its test dates; folds are independent jobs."""
    # iterative learners read their input many times: the feature windows are materialised once
    d = assembler(features).transform(durable(clean(rows, features)))
    folds = durable(folds)
    ids = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]  # a handful of folds
    out = None
    for f in ids:
        part = folds.filter(F.col("fold") == f)
        train = d.join(F.broadcast(part.filter("role = 'train'").select(date)), date, "left_semi")
        test = d.join(F.broadcast(part.filter(F.col("role") == test_role).select(date)), date, "left_semi")
        p = estimator.fit(train).transform(test).withColumn("fold", F.lit(f))
        if probability:
            p = p.withColumn("probability_1", vector_to_array("probability")[1])
        p = p.drop("features", "_scaled", "rawPrediction", "probability")
        out = p if out is None else out.unionByName(p)
    return out


def class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """weight = n / (k · n_class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    t = c.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias(name))  # classes × one row
    return df.join(F.broadcast(w), label)


def score_frame(df: DataFrame, model: PipelineModel, prediction: str = "prediction") -> DataFrame:
    """Prediction of a stored artifact with its size and side."""
    d = model.transform(df)
    return d.withColumns({"prediction_abs": F.abs(prediction), "signal_side": F.signum(prediction).cast("byte")})


def multinomial(label: str, weight: str | None = None) -> LogisticRegression:
    m = LogisticRegression(labelCol=label, featuresCol="features", family="multinomial", maxIter=30, regParam=1e-3)
    return m.setWeightCol(weight) if weight else m


# ---------------------------------------------------------------- regime states

def _log_gauss(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None, :] - mu[None]) ** 2 / var[None]).sum(-1)


def _forward_backward(logb: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    t, k = logb.shape
    shift = logb.max(1, keepdims=True)
    b = np.exp(logb - shift)
    alpha, scale = np.zeros((t, k)), np.zeros(t)
    for i in range(t):
        v = (pi if i == 0 else alpha[i - 1] @ a) * b[i]
        scale[i] = v.sum() or 1e-300
        alpha[i] = v / scale[i]
    beta = np.ones((t, k))
    for i in range(t - 2, -1, -1):
        beta[i] = a @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    xi = np.einsum("ti,ij,tj->ij", alpha[:-1], a, b[1:] * beta[1:] / scale[1:, None])
    return gamma, xi, float(np.log(scale).sum() + shift.sum())


def fit_states(x: np.ndarray, states: int, rounds: int = 50, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Expectation-maximisation of a Gaussian hidden Markov model with diagonal covariances."""
    rng = np.random.default_rng(seed)
    order = np.argsort(x[:, 0] + 1e-9 * rng.random(len(x)))
    parts = np.array_split(order, states)
    mu, var = np.array([x[p].mean(0) for p in parts]), np.array([x[p].var(0) + 1e-6 for p in parts])
    a = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    pi, last = np.full(states, 1.0 / states), -np.inf
    for _ in range(rounds):
        g, xi, ll = _forward_backward(_log_gauss(x, mu, var), pi, a)
        w = g.sum(0)
        pi, a = g[0], xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        mu = g.T @ x / w[:, None]
        var = np.maximum(g.T @ (x * x) / w[:, None] - mu * mu, 1e-8)
        if abs(ll - last) < 1e-6 * max(1.0, abs(ll)):
            break
        last = ll
    return pi, a, mu, var, last


def regime_states(rows: DataFrame, features: Sequence[str], key: Sequence[str], states: Sequence[int] = (2,), ret: str = "log_return", train_until: str | None = None) -> DataFrame:
    """Risk-on posterior per (key, number of states): one fit per group, all groups in parallel.

    A group is one instrument's calendar-bounded series.  Features are standardised on the fit rows; the
    risk-on state has the highest mean return, ties to the lower volatility.  ``train_until`` freezes the
    fit at a date and the rest is filtered forward only.
    """
    d = rows.select(*key, "date", ret, *[c for c in features if c != ret]).withColumn("n_states", F.explode(F.array(*[F.lit(s) for s in states])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        k = int(pdf["n_states"].iloc[0])
        x = pdf[list(features)].to_numpy(dtype=float)
        mask = np.ones(len(x), bool) if train_until is None else (pdf["date"].astype(str) < train_until).to_numpy()
        if mask.sum() < 10 * k:
            return pdf[[*key, "date", "n_states"]].assign(state=-1, p_risk_on=np.nan, risk_on=False)
        mean, sd = x[mask].mean(0), x[mask].std(0) + 1e-12
        z = (x - mean) / sd
        pi, a, mu, var, _ = fit_states(z[mask], k)
        b = _log_gauss(z, mu, var)
        p = np.zeros_like(b)
        for i in range(len(b)):
            prior = pi if i == 0 else p[i - 1] @ a
            v = prior * np.exp(b[i] - b[i].max())
            p[i] = v / (v.sum() or 1e-300)
        g = p[mask]
        r = pdf[ret].to_numpy(dtype=float)[mask]
        m = (g * r[:, None]).sum(0) / np.maximum(g.sum(0), 1e-12)
        vol = np.sqrt(np.maximum((g * r[:, None] ** 2).sum(0) / np.maximum(g.sum(0), 1e-12) - m * m, 0.0))
        best = min(range(k), key=lambda s: (-round(m[s], 12), vol[s]))
        state = p.argmax(1)
        return pdf[[*key, "date", "n_states"]].assign(state=state, p_risk_on=p[:, best], risk_on=state == best)

    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in key) + ", date date, n_states int, state int, p_risk_on double, risk_on boolean"
    return spread(d, *key, "n_states").groupBy(*key, "n_states").applyInPandas(fit, schema)


def state_stability(states: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of risk-on days, number of switches and mean duration of a state."""
    w = W.partitionBy(*key, "n_states").orderBy("date")
    d = states.withColumn("_sw", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0)))
    return d.groupBy(*key, "n_states").agg(F.count(F.lit(1)).alias("n_days"), F.avg(F.col("risk_on").cast("double")).alias("risk_on_share"), F.sum("_sw").alias("n_switches"),
                                          (F.count(F.lit(1)) / (F.sum("_sw") + 1)).alias("mean_duration"))
