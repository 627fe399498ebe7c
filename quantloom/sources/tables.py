"""Table readers with contracts, manifests, verified loads and sinks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.functions.columns import ContractError, require_columns

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (), schema: StructType | str | None = None, fmt: str | None = None) -> DataFrame:
    """Lazy read by suffix (directories of shards are parquet) with a required-column contract."""
    suffix = next((s for s in FORMATS if path.endswith(s)), ".parquet")
    reader = spark.read.format(fmt or FORMATS[suffix])
    if schema is not None:
        reader = reader.schema(schema)
    if (fmt or FORMATS[suffix]) == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    return require_columns(reader.load(path), required)


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256("|".join(sorted(f"{n}:{t}" for n, t in df.dtypes)).encode()).hexdigest()


def validate_schema(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, list[str]]:
    """Missing required, present optional and unknown columns."""
    known = {*required, *optional}
    return {"missing": [c for c in required if c not in df.columns], "optional": [c for c in optional if c in df.columns],
            "extra": [c for c in df.columns if c not in known]}


def table_metadata(df: DataFrame, name: str, symbol: str, date: str) -> DataFrame:
    """Rows, distinct symbols, date range and schema fingerprint in one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(symbol).alias("n_symbols"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
                  ).select(F.lit(name).alias("table_name"), "*", F.lit(schema_fingerprint(df)).alias("fingerprint"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, size and sha256, hashed in the tasks.  Meant for artifact files, each read whole."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))


def duplicate_files(hashes: DataFrame) -> DataFrame:
    """Groups of files with the same content: first path, copies and wasted bytes (all combinable aggregates)."""
    return (hashes.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("keep_path"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("bytes"))
            .filter("copies > 1").withColumn("wasted_bytes", F.col("total_bytes") - F.col("bytes")))


def dataset_manifest(df: DataFrame, dataset_id: str, symbol: str, time: str, semantics: str, tier: str, sha256: str | None = None) -> DataFrame:
    """One-row manifest: counts, range, dtypes, timestamp semantics and quality tier."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(symbol).alias("symbol_count"), F.min(time).cast("string").alias("start"),
                  F.max(time).cast("string").alias("end")).select(
        F.lit(dataset_id).alias("dataset_id"), "*", F.lit(json.dumps(dict(df.dtypes), sort_keys=True)).alias("dtypes"),
        F.lit(semantics).alias("timestamp_semantics"), F.lit(tier).alias("quality_tier"), F.lit(sha256).cast("string").alias("sha256"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def verified_read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Read a parquet artifact only if its files are exactly those of the manifest (columns path, sha256), with the same hashes.

    Files are named by their path below the artifact's folder, so equal names in different partitions stay apart.
    """
    root = path.rstrip("/").split("/")[-1]
    name = lambda c: F.regexp_replace(F.concat(F.lit("/"), c), "^.*/" + re.escape(root) + "/", "")
    have = file_hashes(spark, path).filter(F.col("path").endswith(".parquet")).select(name(F.col("path")).alias("file"), "sha256")
    want = manifest.filter(F.col("path").endswith(".parquet")).select(name(F.col("path")).alias("file"), F.col("sha256").alias("expected"))
    bad = have.join(want, "file", "full").filter(~F.col("expected").eqNullSafe(F.col("sha256")))
    if not bad.isEmpty():
        raise ContractError(f"artifact differs from its manifest: {path}")
    return spark.read.parquet(path)


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Zstd parquet shards bounded in rows; a hot partition value is still written by many tasks."""
    w = df.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_audit(records: DataFrame, path: str, time: str = "ts") -> None:
    """Append-only JSON audit, one folder per UTC date."""
    records.withColumn("audit_date", F.to_date(time)).write.mode("append").partitionBy("audit_date").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replay of the audit; unparsable lines are kept in ``_corrupt``."""
    return spark.read.schema(schema + ", audit_date DATE, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def corpus_fingerprint(df: DataFrame, key: str, digest: str, buckets: int = 4096) -> DataFrame:
    """Order-independent digest of a corpus: sha256 over sorted ``id|sha`` lines, bucket by bucket.

    Ids are put into buckets by hash, each bucket's sorted lines are hashed in its own task, and the
    final digest is taken over the (at most ``buckets``) bucket digests.  Two corpora have the same
    fingerprint exactly when their line sets agree.
    """
    lines = df.select(F.concat_ws("|", F.col(key).cast("string"), F.col(digest)).alias("line"))
    per = lines.groupBy(F.pmod(F.crc32("line"), F.lit(buckets)).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), "\n"), 256).alias("sha256"))
