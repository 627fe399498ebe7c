"""Session and lineage settings shared by the entry point, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "quantloom") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` over all cores.

    For stages that compute much on few bytes: adaptive execution sizes partitions by bytes and would
    merge them into one task.
    """
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), *keys)


JIT_BYTES = "8000"  # HotSpot never compiles a longer method, it interprets every row of it


def short_methods(spark: SparkSession) -> None:
    """Let stages whose generated method would be longer than ``JIT_BYTES`` run as separate, split projections, unless the caller set a limit."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":  # Spark's default
        spark.conf.set(name, JIT_BYTES)


PART_BYTES = 1 << 21  # of compressed input for one partition: some hundred thousand rows; each task also costs seconds of generated code in the widest plans


def by_key(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Partition by ``keys`` into as many parts as the files of ``source`` hold ``PART_BYTES``.

    Windows widen a row from some 40 bytes to kilobytes, while adaptive execution merges partitions by the bytes of the narrow rows: a task then sorts millions
    of wide rows and spills them again and again.  Later windows by these keys use the same partitions, so this replaces their shuffle.
    """
    short_methods(df.sparkSession)
    size = int(str(source._jdf.queryExecution().analyzed().collectLeaves().head().stats().sizeInBytes()))
    return df.repartition(-(-size // PART_BYTES), *keys)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the reliable checkpoint folder of the cluster.

    The folder is read from ``spark.checkpoint.dir``; only a session on one machine (tests) may lack the setting and
    gets a temporary one.  Survives the loss of executors, unlike a local checkpoint.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not is_local(df.sparkSession):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a Parquet table in a new folder under ``spark.checkpoint.dir``.

    Unlike :func:`durable`, later reads take only the columns they need and the planner knows the size, so it may broadcast what is small.  The
    table goes with the session.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return spark.sparkContext.master.split("[")[0] == "local"
