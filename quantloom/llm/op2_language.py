"""Language identification by compression.

For each language a raw-content zstandard dictionary is filled from a bounded sample of labelled texts
(``dictionary_bytes`` per language, chosen by a hash of the id).  A text, folded to lower-case words of letters, is
compressed in blocks under every dictionary; the language with the smallest total wins.  ``rejected`` marks texts
whose margin to the second language is under ``margin``; ties go to the language with more labelled texts, then by name.

A text that is null or has no letter is ``und`` with score 0 and rejected.  Without any labelled row all texts are
``und``.  Rows are independent: repeated rows give repeated results, an empty table none, other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import column, crc_bucket, documents

DICTIONARY_BYTES = 128_000
BLOCK = 2048
LEVEL = 6
MARGIN = 0.01
OVERSAMPLE = 8
NOT_LETTERS = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    return NOT_LETTERS.sub(" ", text.lower())


def learn(labelled: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of labelled texts.

    The sample holds at most ``dictionary_bytes`` characters per language (plus the end of the last text);
    the list has one entry per label.
    """
    rows = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if not sizes:
        return []
    draw = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, OVERSAMPLE * dictionary_bytes / r["chars"]))])
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    sample = (rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
              .withColumn("before", F.coalesce(F.sum(F.length("text")).over(order), F.lit(0)))
              .where(F.col("before") < dictionary_bytes)
              .select("lang", "draw", "doc_id", F.substring("text", 1, dictionary_bytes).alias("text")).collect())
    texts: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["draw"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        texts.setdefault(r["lang"], []).append(folded(r["text"]))
    ranked = sorted(sizes, key=lambda r: (-r["n"], r["lang"]))
    return [(r["lang"], " ".join(texts.get(r["lang"], [])).encode()[:dictionary_bytes]) for r in ranked]


@lru_cache(maxsize=2)
def compressors(learned: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    out = []
    for lang, content in learned:
        params = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(content), write_content_size=False)
        kind = {}
        if len(content) >= 8:
            kind["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kind["dict_data"].precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(compression_params=params, **kind)))
    return out


def classify(text: str | None, packers, margin: float) -> tuple[str, float, bool]:
    words = folded(text) if text else " "
    if not packers or not any(map(str.isalpha, words)):
        return "und", 0.0, True
    data = words.encode()
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(p.compress(b)) for b in blocks), rank, lang) for rank, (lang, p) in enumerate(packers))
    if len(sizes) == 1:
        return sizes[0][2], 1.0, False
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][2], gap, gap < margin


def predict(docs: DataFrame, learned: list[tuple[str, bytes]], margin: float = MARGIN, level: int = LEVEL) -> DataFrame:
    """doc_id, lang_pred, score (relative margin over the second language), rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(learned))

    def run(batches):
        packers = compressors(shared.value, level)
        for batch in batches:
            found = [classify(t.as_py(), packers, margin) for t in column(batch, "text")]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_bucket(F.col("doc_id"), 4) == 2
    learned = learn(docs.where(~F.coalesce(held, F.lit(False))))
    return predict(docs, learned).select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
