"""Mixing to target weights with soft membership.

A multinomial classifier on hashed words and marks learns domains from a labelled table and gives every text posteriors p.  Nonnegative
document rates r then minimise, with t the tokens of a text and T those of all texts,

    1/2 sum_d (sum_i r_i t_i p_id / T - weight_d)^2 + pull / 2 sum_i t_i / T (r_i - 1)^2

by accelerated projected gradient.  In the metric t_i / T a step needs only the residual of each domain, so one pass over
(tokens, posteriors) sums the domains, the driver keeps one short vector per step, and tasks derive the rates from these vectors.  A target of 0 is
a constraint: texts whose posteriors of such domains reach ``BAN`` together have rate 0.  Rates that still move after ``steps`` steps raise a warning.

``SAMPLE`` bounds the expected number of labelled rows the classifier is fitted on; posteriors, sums and rates cover all rows.  Null texts count as empty: 0
tokens, posteriors from the intercepts.  Labelled rows without a document or with a null domain teach nothing.  With fewer than two
labelled domains nothing can be told apart: posteriors are those of the one domain, or none, and rates 1.  Repeated rows get equal rates; an empty table gives no rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import Words, column, documents, lists, raw, saved, slices

BITS = 14
SAMPLE = 20_000
STEPS = 100
TOLERANCE = 1e-6
PULL = 1e-3
BAN = 0.5
TARGETS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}

LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 32
MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()] + [10])


def buckets(buf: np.ndarray, offsets: np.ndarray):
    """Distinct features per text, with offsets, and words per text: words of letters and digits, and how dense each mark and capitals are."""
    words = Words(LETTERS[buf], offsets)
    out, size = [], np.zeros(len(offsets) - 1, np.int64)
    hashed = (words.hash >> np.uint64(64 - BITS)).astype(np.int32)
    for i in range(len(size)):
        text = buf[offsets[i]:offsets[i + 1]]
        count = np.bincount(text, minlength=256)
        marks = np.append(count[MARKS], count[65:91].sum())
        level = np.log2(marks / max(1, len(text)) * 1024 + 1).astype(np.int64)
        signs = ((np.arange(len(marks)) * 16 + level + 1) * 40503 % (1 << BITS)).astype(np.int32)[marks > 0]
        both = np.unique(np.concatenate([hashed[words.offsets[i]:words.offsets[i + 1]], signs]))
        out.append(both)
        size[i] = len(both)
    return (np.concatenate(out) if out else hashed[:0]), np.append(0, np.cumsum(size)), np.diff(words.offsets)


def featured(batches):
    for batch in batches:
        buf, offsets = raw(column(batch, "text"))
        for a, b in slices(offsets):
            values, at, _ = buckets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists(values, at, pa.int32())], ["domain", "buckets"])


def learn(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Domains in order and weights (features and intercept by domain)."""
    known = labelled.where("domain IS NOT NULL").select("doc_id", "domain")
    domains = [r["domain"] for r in known.select("domain").distinct().orderBy("domain").collect()]
    if len(domains) < 2:
        return domains, np.zeros(((1 << BITS) + 1, len(domains)))
    share = min(1.0, sample / known.count())
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.select("doc_id", "text").where(draw < share).join(known.where(draw < share), "doc_id")
    rows = saved(rows.select("domain", "text").mapInArrow(featured, "domain string, buckets array<int>"))
    present = [r["domain"] for r in rows.select("domain").distinct().orderBy("domain").collect()]
    weights = np.zeros(((1 << BITS) + 1, len(domains)))
    if len(present) < 2:
        weights[-1, [d not in present for d in domains]] = -50.0 if present else 0.0
        return domains, weights
    place = F.element_at(F.create_map(*[x for i, d in enumerate(present) for x in (F.lit(d), F.lit(float(i)))]), F.col("domain"))
    vector = CountVectorizerModel.from_vocabulary([str(i) for i in range(1 << BITS)], inputCol="terms", outputCol="features", minTF=1.0, binary=True)
    data = vector.transform(rows.select(place.alias("label"), F.col("buckets").cast("array<string>").alias("terms")))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-3, standardization=False).fit(data)
    cols = [domains.index(d) for d in present]
    weights[-1] = -50.0
    weights[:-1, cols] = model.coefficientMatrix.toArray().T
    weights[-1, cols] = model.interceptVector.toArray()
    return domains, weights


def posteriors(docs: DataFrame, domains: list[str], weights: np.ndarray) -> DataFrame:
    """``docs`` without text columns: its row key, n_tokens and p (one number per domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            buf, offsets = raw(column(batch, "text"))
            for a, b in slices(offsets):
                values, at, n = buckets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                p = np.zeros((b - a, w.shape[1]))
                filled = np.flatnonzero(np.diff(at))
                if len(filled):
                    for d in range(w.shape[1]):
                        p[filled, d] = np.add.reduceat(w[values, d], at[filled])
                p += w[-1]
                p = np.exp(p - p.max(axis=1, keepdims=True, initial=-np.inf))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(n), lists(p.ravel(), np.arange(b - a + 1) * w.shape[1], pa.float64())], [*batch.schema.names[:-1], "n_tokens", "p"])

    keys = [c for c in docs.columns if c != "text"]
    names = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{names}, n_tokens long, p array<double>")


def rates(p: np.ndarray, steps: list[np.ndarray], pull: float, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the given residuals, and the point the next residual is taken at.

    Rows that most likely belong to the ``banned`` domains (those of target 0) are bound to rate 0, however few they are.
    """
    free = p[:, banned].sum(axis=1) < BAN
    r = y = free.astype(float)
    t = 1.0
    for e in steps:
        new = np.where(free, np.maximum(0.0, y - (p @ e + pull * (y - 1)) / (1 + pull)), 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - r)
        r, t = new, t2
    return r, y


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("p")).flatten().to_numpy().reshape(-1, width)


def solve(table: DataFrame, domains: list[str], targets: dict[str, float], pull: float, steps: int) -> list[np.ndarray]:
    """Residuals of the projected-gradient steps over ``table`` (n_tokens, p)."""
    goal = np.array([targets.get(d, 0.0) for d in domains])
    total = table.agg(F.sum("n_tokens")).first()[0]
    history: list[np.ndarray] = []
    if not total or not goal.sum():
        return history
    banned, goal = goal == 0, goal / goal.sum()

    def summed(past):
        def run(batches):
            out = np.zeros(len(domains))
            for batch in batches:
                p = matrix(batch, len(domains))
                out += (batch.column(0).to_numpy() * rates(p, past, pull, banned)[1]) @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(domains))), pa.array(out)], ["d", "sum"])
        return run

    # as many tasks as cores: the steps are many and each does little on a row
    small = table.select("n_tokens", "p").coalesce(max(1, table.sparkSession.sparkContext.defaultParallelism))
    for _ in range(steps):
        found = {r["d"]: r["sum"] for r in small.mapInArrow(summed(list(history)), "d long, sum double").groupBy("d").agg(F.sum("sum").alias("sum")).collect()}
        e = np.array([found[d] for d in range(len(domains))]) / total - goal
        done = bool(history) and np.abs(e - history[-1]).max() < TOLERANCE
        history.append(e)
        if done:
            break
    else:
        warnings.warn(f"mixing rates still moved after {steps} steps", stacklevel=2)
    return history


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, sample: int = SAMPLE, pull: float = PULL, steps: int = STEPS) -> DataFrame:
    """doc_id, mark (hash of the text), n_tokens, p_<domain> and rate for every row of ``docs``; ``labelled`` has doc_id and domain."""
    domains, weights = learn(docs, labelled, sample)
    keys = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    if not domains:
        return saved(posteriors(keys, ["none"], np.zeros(((1 << BITS) + 1, 1)))).select("doc_id", "mark", "n_tokens", F.lit(1.0).alias("rate"))
    table = saved(posteriors(keys, domains, weights))
    history = solve(table, domains, targets, pull, steps) if len(domains) > 1 else []
    banned = np.array([bool(history) and not targets.get(d, 0.0) for d in domains])

    def rated(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(matrix(batch, len(domains)), history, pull, banned)[0])], [*batch.schema.names, "rate"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    out = table.mapInArrow(rated, f"{names}, rate double")
    return out.select("doc_id", "mark", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def domains_of(labels: DataFrame) -> DataFrame:
    """The domains of the given label table: toxic, else clean or low by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low").alias("domain"))


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("mark")
