"""Shared pieces: written intermediate tables, Arrow text access and word hashes in numpy."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a session on one machine may lack the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again.

    The shuffle files behind the written table go as soon as it is complete; the table goes with the session.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    gc.collect()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Remove a table that :func:`saved` wrote and nothing reads any more."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_bucket(doc_id, n: int):
    """crc32 of the id's text modulo ``n``: the fold a contract fixes."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


# ------------------------------------------------------------------ text in Arrow batches

def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_string()) if col.type != pa.large_string() else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row offsets into them; a null row is empty."""
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]] if len(col) else buf[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
LOW_BITS = 16
LOW_POWERS = np.cumprod(np.append(np.ones(1, np.uint64), np.full((1 << LOW_BITS) - 1, BASE, np.uint64)))

HIGH_STEP = np.uint64(pow(int(BASE), 1 << LOW_BITS, 1 << 64))


def powers(at: np.ndarray) -> np.ndarray:
    """BASE to the given exponents, modulo 2^64, from two short tables."""
    out = LOW_POWERS[at & ((1 << LOW_BITS) - 1)]
    most = int(at.max(initial=0)) >> LOW_BITS
    if most:
        high = np.cumprod(np.append(np.ones(1, np.uint64), np.full(most, HIGH_STEP, np.uint64)))
        out = out * high[at >> LOW_BITS]
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """64-bit hashes of rising, disjoint, non-empty byte spans, a bounded number of bytes at a time."""
    out = np.zeros(len(start), np.uint64)
    for lo in range(int(start[0]) if len(start) else 0, int(end[-1]) if len(end) else 0, SLICE_BYTES):
        hi = lo + SLICE_BYTES
        a, b = np.searchsorted(end, lo, side="right"), np.searchsorted(start, hi)
        if a >= b:
            continue
        s, e = np.maximum(start[a:b], lo), np.minimum(end[a:b], hi)
        size = e - s
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        code = BYTE_CODE[fold[buf[step + np.repeat(s, size)]]]
        code *= powers(step + np.repeat(s - start[a:b], size))
        # each place is mixed before the sum: a plain polynomial modulo 2^64 gives a Thue-Morse word and its complement one value
        out[a:b] += np.add.reduceat(mix(code), first)
    return mix(out + (end - start).astype(np.uint64) * STEP)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts: 64-bit hash, byte range, and word offsets per text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER):
        n = len(buf)
        inside = ~SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first[0] = True
        gap = np.ones(n + 1, bool)
        gap[1:] = ~np.append(inside, False)[:-1]  # position before is a space
        begin = inside & (gap[:n] | first[:n])
        after = np.append(~inside[1:], True) if n else np.zeros(0, bool)
        stop = inside & (after | first[1:n + 1])
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.hash = span_hashes(buf, self.start, self.end, fold)

    def doc(self) -> np.ndarray:
        """Row number of each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words of one text and their row numbers; shorter texts give none."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out *= STEP
            out += self.hash[j:j + n]
        doc = self.doc()
        keep = doc[:n] == doc[k - 1:]
        return mix(out[keep]), doc[:n][keep]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def lists(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind or pa.array(values).type))
