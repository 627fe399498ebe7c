"""Learners MLlib lacks: Huber regression by stochastic gradients, boosting stopped on a time-ordered tail, and stored artifacts with a contract.

All have ``fit(rows)`` on a frame with a ``features`` vector and give an object with ``transform(rows)``, so they stand where MLlib estimators do.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.functions.columns import require_columns
from quantloom.operators.models import class_weights, clean, score_frame
from quantloom.session import durable
from quantloom.sources.tables import ContractError, file_hashes


def time_tail(df: DataFrame, fraction: float = 0.1, date: str = "date", name: str = "tail") -> DataFrame:
    """Flag the rows of the newest dates that hold at most ``fraction`` of all rows, and at least the newest date; whole dates only."""
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("_c"))  # calendar-sized
    newest = F.sum("_c").over(W.orderBy(F.desc(date)))
    d = days.withColumns({"_after": newest, "_n": F.sum("_c").over(W.partitionBy()), "_last": F.max(date).over(W.partitionBy())})
    cut = d.agg(F.min(F.when((F.col("_after") <= F.col("_n") * fraction) | (F.col(date) == F.col("_last")), F.col(date))).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(name, F.coalesce(F.col(date) >= F.col("_cut"), F.lit(False))).drop("_cut")  # one-row side


# ---------------------------------------------------------------- Huber regression by stochastic gradients

class HuberSGD:
    """Linear regression with Huber loss and an L2 penalty by mini-batch gradients on standardised features.

    Rows fall into ``batches`` by hash; a step sums the gradient of one batch in column arithmetic, partial sums combine on the map side, and only
    k + 1 numbers reach the driver.  A step is scaled by n / batches, so an uneven batch does not weigh more.  Step sizes fall as t^-1/4 and the
    coefficients are averaged over the second half of the epochs.  Fitting ends when an epoch's loss has not improved by ``tol`` ``patience`` times.
    """

    def __init__(self, target: str, alpha: float = 1e-4, epsilon: float = 0.1, epochs: int = 1000, batches: int = 2, tol: float = 1e-4, patience: int = 5):
        self.target, self.alpha, self.epsilon, self.epochs, self.batches, self.tol, self.patience = target, alpha, epsilon, epochs, batches, tol, patience

    def fit(self, rows: DataFrame) -> LinearFit:
        y = F.col(self.target).cast("double")
        d = rows.filter(y.isNotNull() & ~F.isnan(y)).select(vector_to_array("features").alias("x"), y.alias("y"))
        first = d.first()
        if first is None:
            return LinearFit(0.0, np.zeros(0))
        k = len(first["x"])
        s = d.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{p}{i}") for i in range(k) for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
        mean = np.array([s[f"m{i}"] for i in range(k)])
        sd = np.array([s[f"s{i}"] if s[f"s{i}"] > 1e-12 else 1.0 for i in range(k)])
        z = d.select("y", *[((F.col("x")[i] - mean[i]) / sd[i]).alias(f"z{i}") for i in range(k)])
        z = durable(z.withColumn("b", F.pmod(F.xxhash64(*z.columns), F.lit(self.batches))))
        w, total, best, stale, step, kept = np.zeros(k + 1), s["n"] / self.batches, np.inf, 0, 0, []
        for _ in range(self.epochs):
            loss = 0.0
            for b in range(self.batches):
                g, part = self._sums(z.filter(F.col("b") == b), w, k)
                loss += part
                step += 1
                grad = g / total
                grad[1:] += self.alpha * w[1:]
                w = w - grad / ((k + 1) * step ** 0.25) * 2.0
            kept.append(w)
            loss = loss / s["n"] + 0.5 * self.alpha * float(w[1:] @ w[1:])
            stale = stale + 1 if loss > best - self.tol else 0
            best = min(best, loss)
            if stale >= self.patience:
                break
        else:
            warnings.warn(f"Huber gradients had not come to rest after {self.epochs} epochs", stacklevel=2)
        w = np.mean(kept[len(kept) // 2:], axis=0)
        return LinearFit(float(w[0] - w[1:] @ (mean / sd)), w[1:] / sd)

    def _sums(self, batch: DataFrame, w: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        e = sum((F.col(f"z{i}") * float(w[i + 1]) for i in range(k)), F.lit(float(w[0]))) - F.col("y")
        d = batch.withColumn("e", e).withColumn("g", F.greatest(F.lit(-self.epsilon), F.least(F.lit(self.epsilon), F.col("e"))))
        a = F.abs("e")
        loss = F.when(a <= self.epsilon, 0.5 * a * a).otherwise(self.epsilon * a - 0.5 * self.epsilon ** 2)
        r = d.agg(F.sum("g").alias("g"), *[F.sum(F.col("g") * F.col(f"z{i}")).alias(f"g{i}") for i in range(k)], F.sum(loss).alias("loss")).first()
        return np.array([r["g"] or 0.0, *[r[f"g{i}"] or 0.0 for i in range(k)]]), r["loss"] or 0.0


class LinearFit:
    """Intercept and coefficients on the raw scale."""

    def __init__(self, intercept: float, coefficients: np.ndarray):
        self.intercept, self.coefficients = intercept, coefficients

    def transform(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        x = vector_to_array("features")
        return rows.withColumn(name, sum((x[i] * float(c) for i, c in enumerate(self.coefficients)), F.lit(self.intercept)))


# ---------------------------------------------------------------- boosting stopped on a tail

class StoppedTrees:
    """Boosted regression trees whose number of rounds, at most ``rounds``, is the one that is best on the newest dates of the training rows."""

    def __init__(self, target: str, rounds: int = 500, depth: int = 3, rate: float = 0.1, fraction: float = 0.1, seed: int = 42, tol: float = 1e-3, date: str = "date"):
        self.target, self.fraction, self.date = target, fraction, date
        self.learner = GBTRegressor(labelCol=target, featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed, validationIndicatorCol="tail", validationTol=tol)

    def fit(self, rows: DataFrame):
        return self.learner.fit(time_tail(rows, self.fraction, self.date).select("features", self.target, "tail"))


class StoppedClasses:
    """Class-balanced ordinal classes 0 … k-1: one boosted model per class against the rest, weighted by n / (k n_class), each stopped on the tail."""

    def __init__(self, label: str, classes: int, rounds: int = 500, depth: int = 3, rate: float = 0.1, fraction: float = 0.1, seed: int = 42, tol: float = 1e-3, date: str = "date"):
        self.label, self.classes, self.fraction, self.date = label, classes, fraction, date
        self.learner = GBTClassifier(labelCol="_is", featuresCol="features", weightCol="class_weight", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed, validationIndicatorCol="tail", validationTol=tol)

    def fit(self, rows: DataFrame) -> ClassFit:
        d = durable(time_tail(class_weights(rows, self.label), self.fraction, self.date).select("features", self.label, "class_weight", "tail"))
        return ClassFit({c: self.learner.fit(d.withColumn("_is", (F.col(self.label) == c).cast("double"))) for c in range(self.classes)})


class ClassFit:
    """Class of the largest one-against-rest probability; ties go to the smaller class."""

    def __init__(self, models: dict):
        self.models = models

    def rounds(self) -> dict[int, int]:
        return {c: m.getNumTrees for c, m in self.models.items()}

    def importances(self) -> np.ndarray:
        """Gain importances, averaged over the classes."""
        return np.mean([m.featureImportances.toArray() for m in self.models.values()], axis=0)

    def transform(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        drop = ["rawPrediction", "probability", "prediction"]
        d = rows
        for c, m in self.models.items():
            d = m.transform(d).withColumn(f"_p{c}", vector_to_array("probability")[1]).drop(*drop)
        top: Column = F.greatest(*[F.col(f"_p{c}") for c in self.models])
        pick = F.coalesce(*[F.when(F.col(f"_p{c}") == top, F.lit(float(c))) for c in self.models])
        return d.withColumn(name, pick).drop(*[f"_p{c}" for c in self.models])


# ---------------------------------------------------------------- stored artifacts

def save_artifact(model: PipelineModel, path: str, features: Sequence[str], target: str, spark: SparkSession) -> None:
    """Write a fitted pipeline with its contract: feature columns in order, target, and the hash of every file of the model."""
    path = path.rstrip("/")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"features": list(features), "target": target}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")
    _hashes(spark, path).write.mode("overwrite").parquet(f"{path}/hashes")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str], str]:
    """The stored pipeline, its features and target; refused when a file is missing, added or changed."""
    path = path.rstrip("/")
    want = spark.read.parquet(f"{path}/hashes").withColumnRenamed("sha256", "expected")
    bad = _hashes(spark, path).join(want, "file", "full").filter(~F.col("expected").eqNullSafe(F.col("sha256")))
    if not bad.isEmpty():
        raise ContractError(f"stored model differs from its contract: {path}")
    contract = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    return PipelineModel.load(f"{path}/model"), contract["features"], contract["target"]


def _hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the model and the contract, named below the artifact's folder."""
    both = file_hashes(spark, f"{path}/model").unionByName(file_hashes(spark, f"{path}/contract"))
    return both.select(F.regexp_extract("path", r"/((?:model|contract)/(?!.*/(?:model|contract)/).*)$", 1).alias("file"), "sha256")


def score_stored(df: DataFrame, path: str, prediction: str = "prediction") -> DataFrame:
    """Score a table or a stream by a stored artifact: null, NaN and infinite features count as 0; a missing feature column is an error."""
    model, features, _ = load_artifact(df.sparkSession, path)
    require_columns(df, features)
    drop = [c for c in ("features", "rawPrediction", "probability", "_scaled") if c not in df.columns]
    return score_frame(clean(df, features), model, prediction).drop(*drop)
