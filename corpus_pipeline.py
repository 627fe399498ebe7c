"""The corpus pipeline: five stages, each one operator of ``quantloom.llm``, each written as Parquet and read again.

Rows whose doc_id repeats are told apart by their text where a stage joins its verdict; equal rows share one verdict.  Nulls, empty texts, empty
tables and further columns are handled as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import op3_decontamination, op5_quality, op8_mixing, op9_pii, op10_jaccard
from quantloom.llm.common import saved

ORACLE_SQL = None  # trained models and a near-duplicate join have no SQL; tests hold the stages against plain versions


def keyed(docs: DataFrame, verdict: DataFrame, how: str) -> DataFrame:
    """``docs`` with the columns of ``verdict`` (doc_id, mark, ...), ``mark`` being the hash of the text."""
    right = verdict.withColumnsRenamed({"doc_id": "_v_doc", "mark": "_v_mark"})
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_v_doc")) & (F.xxhash64("text") == F.col("_v_mark")), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity band keep."""
    kept = op5_quality.assess(docs, mark=True).where("kept").select("doc_id", "mark").distinct()
    return keyed(docs, kept, "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents; those without words stay."""
    groups = op10_jaccard.join(docs)
    first = groups.where("doc_id = component_id OR component_id IS NULL").select(F.col("doc_id").alias("_v_doc")).distinct()
    out = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_v_doc")), "left_semi")
    repeated = groups.groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return out
    return out.withColumn("_mark", F.xxhash64("text")).dropDuplicates(["doc_id", "_mark"]).drop("_mark")  # equal rows are copies too


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op3_decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name="_items").where(F.size("_items") == 0).drop("_items")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return op9_pii.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the fitted rate; documents of rate 0 go."""
    labels = op8_mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = op8_mixing.mix(docs, labels).where("rate > 0").select("doc_id", "mark", "n_tokens", "rate").dropDuplicates(["doc_id", "mark"])
    return keyed(docs.drop("n_tokens", "rate"), rated, "inner").drop("_v_doc", "_v_mark")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
