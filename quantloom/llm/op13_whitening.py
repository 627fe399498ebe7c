"""Whitening of embeddings by spectrum slicing.

Every entry c becomes ``floor(256 c)``.  The mean, the covariance and its check are taken over the distinct vectors.  Spark counts them, adds the
sums per dimension exactly, then the products of centred entries, task by task; only the dim x dim covariance reaches the driver.

There the leading eigenpairs are found one by one.  The pivots of an LDL' factorisation (Bunch and Kaufman's, with blocks of 1 and 2) of the shifted
covariance count its eigenvalues above the shift; bisection on these counts isolates eigenvalue k in an interval of its own.  Rayleigh quotient iteration starts there
and converges cubically; if it leaves the interval, the interval is halved and it starts anew.  Counts just above and below the result certify its number.  Eigenvalues that
no shift parts (equal up to rounding) are one cluster; its vectors are iterated as a block and any orthonormal basis of it serves.

Rows with a null vector, a null or non-finite entry go; so do rows whose length is not the most frequent one (the longer one of ties) and empty
vectors.  Integers beyond 64 bits saturate; a deviation beyond them is null.  Components whose eigenvalue is zero up to rounding have
``whitened`` null and no share in ``identity_error``.  Repeated rows are all returned and count once in the fit; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

SCALE = 256.0
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
BUNCH = (1 + 17**0.5) / 8


# ------------------------------------------------------------------ eigenpairs of a small symmetric matrix

def positive_pivots(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues: the positive pivots of P A P' = L D L' (Sylvester's law of inertia)."""
    a = matrix.copy()
    n, k, count = len(a), 0, 0
    while k < n:
        width = 1
        if k + 1 < n:
            column = np.abs(a[k + 1:, k])
            r = int(column.argmax()) + k + 1
            most = column[r - k - 1]
            if abs(a[k, k]) < BUNCH * most:
                other = np.abs(a[r, k:])
                other[r - k] = 0.0
                there = other.max()
                if abs(a[k, k]) * there >= BUNCH * most * most:
                    pass
                elif abs(a[r, r]) >= BUNCH * there:
                    swap(a, k, r)
                else:
                    swap(a, k + 1, r)
                    width = 2
        if width == 1:
            pivot = a[k, k]
            if pivot != 0.0:
                count += pivot > 0
                left = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(left, left / pivot)
        else:
            block = a[k:k + 2, k:k + 2].copy()
            count += 1  # the block's determinant is negative: one eigenvalue of each sign
            left = a[k + 2:, k:k + 2].copy()
            a[k + 2:, k + 2:] -= left @ np.linalg.solve(block, left.T)
        k += width
    return count


def swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class Slices:
    """Leading eigenpairs of a positive semidefinite matrix by counts of eigenvalues above shifts."""

    def __init__(self, matrix: np.ndarray):
        self.a, self.n = matrix, len(matrix)
        self.top = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 4 * EPS)
        self.tiny = 8 * self.n * EPS * self.top
        self.known: dict[float, int] = {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_pivots(self.a - shift * np.eye(self.n))
        return self.known[shift]

    def bracket(self, k: int) -> tuple[float, float]:
        """(low, high) with fewer than k eigenvalues above ``high`` and at least k above ``low``, from the counts known."""
        low = max((s for s, c in self.known.items() if c >= k), default=-self.tiny - EPS)
        high = min((s for s, c in self.known.items() if c < k and s > low), default=self.top + self.tiny)
        return low, high

    def isolate(self, k: int) -> tuple[float, float, int, int]:
        """An interval that holds eigenvalue k, and the numbers (first, last) of all it holds: k alone unless it is a cluster."""
        low, high = self.bracket(k)
        first, last = 1, self.n
        while True:
            first = self.above(high) + 1 if high in self.known else 1
            last = self.above(low) if low in self.known else self.n
            if first == last or high - low <= self.tiny:
                return low, high, first, last
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)

    def pairs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k eigenvalues and their unit vectors as columns."""
        values, vectors = [], np.zeros((self.n, 0))
        if self.top == 0.0:
            return np.zeros(min(k, self.n)), np.eye(self.n)[:, :k]
        while len(values) < min(k, self.n):
            low, high, first, last = self.isolate(len(values) + 1)
            if first == last:
                value, vector = self.iterate(first, low, high, vectors)
                values.append(value)
                vectors = np.column_stack([vectors, vector])
            else:
                found, block = self.cluster((low + high) / 2, last - first + 1, vectors)
                values += list(found)
                vectors = np.column_stack([vectors, block])
        return np.array(values[:k]), vectors[:, :k]

    def solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        for step in (0.0, EPS, 16 * EPS):
            try:
                out = np.linalg.solve(self.a - (shift + step * self.top) * np.eye(self.n), right)
                if np.isfinite(out).all():
                    return out
            except np.linalg.LinAlgError:
                pass
        raise ArithmeticError("no shifted system near the eigenvalue can be solved")

    def iterate(self, k: int, low: float, high: float, before: np.ndarray) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration inside an interval that holds eigenvalue k alone."""
        while True:
            start = np.random.default_rng(k).standard_normal(self.n)
            middle = (low + high) / 2
            for _ in range(2):  # towards the eigenvector next to the middle
                start = unit(clear(self.solve(middle, unit(clear(start, before))), before))
            value, residual, vector = self.refine(start, before)
            margin = max(2 * residual, self.tiny)
            if low < value < high and self.above(value + margin) < k <= self.above(value - margin):
                return value, vector
            if high - low <= self.tiny:
                return value, vector  # the interval itself is the certificate
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)

    def refine(self, vector: np.ndarray, before: np.ndarray) -> tuple[float, float, np.ndarray]:
        value = float(vector @ self.a @ vector)
        residual = float(np.linalg.norm(self.a @ vector - value * vector))
        for _ in range(20):  # cubic: three or four steps; a step that gains nothing ends it
            trial = unit(clear(self.solve(value, vector), before))
            quotient = float(trial @ self.a @ trial)
            rest = float(np.linalg.norm(self.a @ trial - quotient * trial))
            if rest >= residual:
                break
            value, residual, vector = quotient, rest, trial
        return value, residual, vector

    def cluster(self, shift: float, size: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An orthonormal basis of ``size`` eigenvalues equal up to rounding."""
        block = np.random.default_rng(size).standard_normal((self.n, size))
        for _ in range(4):
            block = np.linalg.qr(clear(self.solve(shift, np.linalg.qr(clear(block, before))[0]), before))[0]
        return np.einsum("ij,ij->j", block, self.a @ block), block


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def clear(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``x`` without its parts along the columns of ``before``, twice for rounding."""
    for _ in range(2):
        x = x - before @ (before.T @ x)
    return x


# ------------------------------------------------------------------ Spark

def integers(batches):
    """vec_id and the integers of each valid row as bytes, with their number."""
    for batch in batches:
        vectors = batch.column(1)
        width = np.asarray(vectors.value_lengths().fill_null(0))
        values = vectors.flatten().cast(pa.float64())
        flat = values.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(width)), width)
        good = width > 0
        good &= np.asarray(vectors.is_valid())
        good[row[~np.isfinite(flat)]] = False
        scaled = np.floor(np.where(np.isfinite(flat), flat, 0.0) * SCALE)
        x = np.where(np.abs(scaled) < 2.0**63, scaled, 0.0).astype(np.int64)
        x[scaled >= 2.0**63], x[scaled <= -(2.0**63)] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        offsets = np.append(0, np.cumsum(width)) * 8
        packed = pa.Array.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(x.tobytes())])
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), packed.filter(keep).cast(pa.binary())], ["vec_id", "x"])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of packed integers as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dim)


def sums(dim: int):
    """Row count and exact sums per dimension of a task: (dimension, count, total); totals as decimal text."""
    def run(batches):
        n, total = 0, [0] * dim
        for batch in batches:
            x = matrix(batch.column(0), dim)
            n += len(x)
            big = len(x) * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) >= 1 << 62
            part = x.astype(object).sum(axis=0) if big else x.sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], ["k", "n", "total"])
    return run


def products(dim: int, mean: np.ndarray, basis: np.ndarray):
    """Upper triangle of the sums of products of (x - mean) basis, one row (i, j, value) per entry and task."""
    width = basis.shape[1]
    left, right = np.triu_indices(width)

    def run(batches):
        total, any_rows = np.zeros((width, width)), False
        for batch in batches:
            y = (matrix(batch.column(0), dim) - mean) @ basis
            total += y.T @ y
            any_rows = any_rows or len(y) > 0
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(total[left, right])], ["i", "j", "value"])
    return run


def covariance(fit: DataFrame, dim: int, n: int, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the rows of ``fit`` seen through ``basis``; a dim x dim (or smaller) matrix reaches the driver."""
    basis = np.eye(dim) if basis is None else basis
    rows = fit.mapInArrow(products(dim, mean, basis), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for i, j, value in rows:
        out[i, j] = out[j, i] = value / n
    return out


def projected(dim: int, n: int, total: list[int], mean: np.ndarray, basis: np.ndarray, zero: np.ndarray, explained: list, error: float):
    """Rows of the result for packed rows (vec_id, x)."""
    width = basis.shape[1]
    most = max(map(abs, total), default=0)
    shift = np.array(total, object)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            reach = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + most
            if dim * reach * reach < 1 << 63:
                deviation = pa.array(((n * x - shift.astype(np.int64)) ** 2).sum(axis=1))
            else:
                exact = ((n * x.astype(object) - shift) ** 2).sum(axis=1)
                deviation = pa.array([int(d) if d < 1 << 63 else None for d in exact], pa.int64())
            white = (x - mean) @ basis
            take = pa.array(np.repeat(np.arange(len(x)), width))
            component = np.tile(np.arange(width), len(x))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(take), pa.array(component + 1, pa.int32()), pa.array(np.full(len(component), n), pa.int64()), deviation.take(take),
                pa.array(white.ravel(), mask=zero[component]), pa.array([explained[c] for c in component], pa.float64()), pa.array(np.full(len(component), error))], RESULT)
    return run


RESULT = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each valid row and leading component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select("vec_id", "embedding").mapInArrow(integers, f"vec_id {kind}, x binary")
    distinct = saved(rows.select("x").distinct())
    lengths = rows.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = lengths["bytes"] // 8
    fit = distinct.where(F.length("x") == dim * 8)
    found = fit.mapInArrow(sums(dim), "k int, n long, total string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("k").collect()  # dim rows
    n, total = found[0]["n"], [int(r["total"]) for r in found]
    mean = np.array([t / n for t in total])
    spread = covariance(fit, dim, n, mean)
    values, vectors = Slices(spread).pairs(components)
    trace = float(np.trace(spread))
    zero = values <= 8 * dim * EPS * max(trace, 0.0)
    basis = np.where(zero, 0.0, vectors / np.sqrt(np.where(zero, 1.0, values)))
    live = np.flatnonzero(~zero)
    error = float(np.abs(covariance(fit, dim, n, mean, basis[:, live]) - np.eye(len(live))).max(initial=0.0)) if len(live) else 0.0
    explained = [float(v) / trace if trace > 0 else None for v in values]
    return rows.where(F.length("x") == dim * 8).mapInArrow(projected(dim, n, total, mean, basis, zero, explained, error), schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
