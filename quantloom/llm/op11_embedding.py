"""Near-duplicate embeddings by random-hyperplane sign hashing, exact cosines and connected components.

1. Equal vectors of one label are one *point*.  A point stands in one bucket of each of several tables: the signs of its projections on ``bits``
   random hyperplanes.  Two vectors at cosine c agree on one sign with probability 1 - acos(c) / pi; the number of bits grows with the
   logarithm of the largest label, the number of tables with the bits, so that a pair at the threshold shares no bucket with probability ``MISS``.
2. Buckets of one point go.  The smallest point of a bucket is its *home*; a point stands once under each home, with the list of the
   tables that led there, so groups of copies that share most tables are not moved once a table.
3. Homes of more than ``BLOCK`` points are cut into blocks by hash, and pairs of blocks are the units of work.  Cosines inside are matrix products;
   no pair leaves the task.  A linked pair counts where the first table on which both agree is one of the home's, so once.  A unit
   gives, per point, the number of links and the smallest point it is connected with inside; Spark adds the former and finds components of the latter.

Cosines are taken in double precision of vectors scaled by their largest entry; those within 1e-9 of the threshold are recomputed with exactly rounded sums.
A null label, a null or zero vector and one with null or non-finite entries link with nothing; so do vectors of different lengths.
Copies link with each other.  A null vec_id is no smallest id unless all of its component are null; then the component is null and ``kept`` is true.  Repeated ids are vectors
of their own.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import mix, saved
from quantloom.llm.graph import components, lowest

THRESHOLD = 0.93
MISS = 0.004
SPARE_BITS = 5
BLOCK = 512
SEED = 11
NEAR = 1e-9


def shape(points: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for a largest label of ``points`` vectors."""
    bits = min(60, math.ceil(math.log2(max(2, points))) + SPARE_BITS)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


# ------------------------------------------------------------------ vectors

def packed(batches):
    """vec_id, label and the vector's bytes as doubles or floats; null where it links with nothing."""
    for batch in batches:
        vectors, label = batch.column(1), batch.column(2)
        width = np.asarray(vectors.value_lengths().fill_null(0))
        values = vectors.flatten()
        values = values if pa.types.is_floating(values.type) and values.type != pa.float16() else values.cast(pa.float64())
        flat = values.to_numpy(zero_copy_only=False)  # nulls become NaN
        row = np.repeat(np.arange(len(width)), width)
        good = np.asarray(vectors.is_valid()) & np.asarray(label.is_valid())
        good &= np.bincount(row[flat != 0], minlength=len(width)) > 0
        good[row[~np.isfinite(flat)]] = False
        offsets = np.append(0, np.cumsum(width)).astype(np.int64) * flat.itemsize
        data = pa.Array.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), label, pc.if_else(pa.array(good), data, pa.scalar(None, pa.large_binary())).cast(pa.binary())], ["vec_id", "label", "vec"])


def directions(column: pa.Array, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors in double precision, by length: (row numbers, matrix)."""
    width = np.asarray(pc.binary_length(column))
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype).reshape(len(at), -1).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def codes(x: np.ndarray, table: int, bits: int) -> np.ndarray:
    """Signs of the projections on the table's hyperplanes as one number a row."""
    planes = np.random.default_rng([SEED, table, x.shape[1]]).standard_normal((x.shape[1], bits))
    return (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))


def buckets(bits: int, tables: int, dtype):
    """One row (bucket, table, id) per point and table; label, length, table and signs are hashed into the bucket."""
    def run(batches):
        for batch in batches:
            ids, space = batch.column(0), np.asarray(batch.column(1)).view(np.uint64)
            for at, x in directions(batch.column(2), dtype):
                for t in range(tables):
                    key = mix(mix(space[at] + np.uint64(t)) ^ codes(x, t, bits).view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), t, np.int16)), ids.take(pa.array(at))], ["bucket", "t", "id"])
    return run


# ------------------------------------------------------------------ units of work

def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def close_pairs(x: np.ndarray, same: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j at or over the threshold; ``same`` says whether both sides are one block (all pairs) or two (pairs across, side 0 and 1)."""
    left = np.flatnonzero(~same) if same.any() else np.arange(len(x))
    right = np.flatnonzero(same) if same.any() else left
    product = x[left] @ x[right].T
    i, j = np.nonzero(product >= threshold - NEAR)
    cosine, i, j = product[i, j], left[i], right[j]
    if not same.any():
        upper = i < j
        cosine, i, j = cosine[upper], i[upper], j[upper]
    for k in np.flatnonzero(np.abs(cosine - threshold) <= NEAR):
        cosine[k] = exact_cosine(x[i[k]], x[j[k]])
    keep = cosine >= threshold
    return i[keep], j[keep]


def linked(bits: int, tables: int, threshold: float, dtype):
    """(id, links, root) of the points of each unit (home, low, high), from rows sorted by unit."""
    def unit(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        ids = np.asarray(table["id"])
        order = np.argsort(ids)
        table, ids = table.take(pa.array(order)), ids[order]
        low, high, block = (np.asarray(table[c]) for c in ("low", "high", "block"))
        across = (block != low) & (low != high)
        space, copies = np.asarray(table["space"]), np.asarray(table["copies"])
        here = np.zeros((len(ids), tables), bool)
        lists = table["tables"].combine_chunks()
        here[np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())] = True
        pairs = []
        for at, x in directions(table["vec"].combine_chunks(), dtype):
            i, j = close_pairs(x, across[at], threshold) if low[0] == high[0] or len(np.unique(across[at])) == 2 else (np.zeros(0, int),) * 2
            fit = space[at[i]] == space[at[j]]
            i, j = i[fit], j[fit]
            some, index = np.unique(np.append(i, j), return_inverse=True)
            a, b = index[:len(i)], index[len(i):]
            first = np.full(len(i), -1)
            for t in range(tables):
                open_pairs = np.flatnonzero(first < 0)
                if not len(open_pairs):
                    break
                signs = codes(x[some], t, bits)
                first[open_pairs[signs[a[open_pairs]] == signs[b[open_pairs]]]] = t
            mine = (first >= 0) & here[at[i], first]
            pairs.append((at[i[mine]], at[j[mine]]))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        if not len(i):
            return None
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[lowest(len(ids), i, j)[some]])], ["id", "links", "root"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            names = batch.schema.names
            keys = np.column_stack([np.asarray(batch.column(names.index(c))) for c in ("home", "low", "high")])
            cuts = np.append(np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys))
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key is not None and (keys[a] != key).any():
                    out = unit(held)
                    if out is not None:
                        yield out
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            out = unit(held)
            if out is not None:
                yield out
    return run


# ------------------------------------------------------------------ Spark

def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label)."""
    kinds = {c: embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "embedding", "label")}
    dtype = np.float32 if kinds["embedding"] == "array<float>" else np.float64
    rows = embeddings.select("vec_id", "embedding", "label").mapInArrow(packed, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary")
    rows = rows.withColumn("mark", F.when(F.col("vec").isNotNull(), F.unhex(F.substring(F.sha2("vec", 256), 1, 32))))
    points = rows.where("mark IS NOT NULL").groupBy("label", "mark").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
    points = saved(points.select(F.monotonically_increasing_id().alias("id"), "label", "mark", "least", "copies", F.xxhash64("label", F.length("vec")).alias("space"), "vec"))
    largest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, tables = shape(largest, threshold, miss)
    every = points.select("id", "space", "vec").mapInArrow(buckets(bits, tables, dtype), "bucket long, t short, id long")
    several = saved(every.groupBy("bucket").agg(F.min("id").alias("home"), F.max("id").alias("other")).where("home <> other").select("bucket", "home"))
    members = saved(every.join(several, "bucket").groupBy("home", "id").agg(F.collect_set("t").alias("tables")))  # at most one entry a table
    sizes = members.groupBy("home").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = members.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = placed.select("home", "id", "tables", "block", other.alias("with")).select("home", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "id", "tables")
    units = units.join(points.select("id", "space", "copies", "vec"), "id").repartition("home", "low", "high").sortWithinPartitions("home", "low", "high")
    found = saved(units.select("home", "low", "high", "block", "id", "tables", "space", "copies", "vec").mapInArrow(linked(bits, tables, threshold, dtype), "id long, links long, root long"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = points.select("id", "label", "mark", "least", "copies").join(links, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    known = saved(known.select("label", "mark", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root")))
    tops = known.groupBy("root").agg(F.min("least").alias("top"))
    known = known.join(tops, "root").select("label", "mark", (F.col("links") + F.col("copies") - 1).alias("n_links"), "top")
    out = rows.select("vec_id", "label", "mark").join(known, ["label", "mark"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("top"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
