"""Rows keep their numbers, words their hashes and forbidden domains their rate 0, whatever the layout, the letters and the shares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from quantloom.llm import op1_tokens, op5_quality, op6_maxent, op8_mixing, op10_jaccard
from quantloom.llm.common import LOWER, span_hashes


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_swapped_letters_stay_apart(spark, n):
    a, b = thue_morse(n)
    buf = np.frombuffer((a + b).encode(), np.uint8)
    first, second = span_hashes(buf, np.array([0, n]), np.array([n, 2 * n]), LOWER)
    assert first != second and len({int(x) & 0xFFFFFFFF for x in (first, second)}) == 2
    docs = spark.createDataFrame([(1, a, "en"), (2, b, "en"), (3, f"{a}\n{b}", "en")], "doc_id long, text string, lang string")
    links = {r.doc_id: r.component_id for r in op10_jaccard.join(docs).collect()}
    assert links[1] == 1 and links[2] == 2
    assert all(r.n_dup_lines == 0 for r in op5_quality.assess(docs).collect())
    known = {r.doc_id: r.n_known for r in op6_maxent.score(docs.where("doc_id < 3"), F.col("doc_id") == 1).collect()}
    assert known == {1: 2, 2: 1}


def test_hash_does_not_depend_on_the_place_of_the_word():
    draw = random.Random(5)
    word = "".join(draw.choice("abcdefghij") for _ in range(3000)).encode()
    buf = np.frombuffer(b"x" * 777 + word + b" " * ((1 << 21) - 1500) + word, np.uint8)
    second = 777 + 3000 + (1 << 21) - 1500
    a, b = span_hashes(buf, np.array([777, second]), np.array([3777, second + 3000]), LOWER)
    assert a == b


def test_scores_do_not_depend_on_the_cores_of_a_job(spark, tmp_path, monkeypatch):
    draw = random.Random(2)
    rows = [(i, " ".join(f"w{draw.randrange(300)}" for _ in range(draw.randrange(1, 60)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs, key, saved = spark.read.parquet(str(tmp_path / "docs")), "spark.sql.leafNodeDefaultParallelism", op6_maxent.saved
    condition = F.col("doc_id") % 3 != 0
    want = sorted(map(tuple, op6_maxent.score(docs, condition, head_size=20).select("doc_id", "n_known", F.round("base_score", 6)).collect()))
    before = spark.conf.get("spark.sql.files.openCostInBytes")

    def moved(df):
        out = saved(df)
        spark.conf.set(key, "2")
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30) if spark.conf.get("spark.sql.files.openCostInBytes") == before else before)
        return out

    monkeypatch.setattr(op6_maxent, "saved", moved)
    try:
        got = sorted(map(tuple, op6_maxent.score(docs, condition, head_size=20).select("doc_id", "n_known", F.round("base_score", 6)).collect()))
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert got == want
    brute = {d: known for d, _, known, _, _ in plain.unigram(rows)}
    full = {r.doc_id: r.n_known for r in op6_maxent.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, head_size=20).collect()}
    assert full == brute


def test_rare_toxic_rows_leave(spark):
    draw = random.Random(7)
    kind = lambda w: " ".join(draw.choice(w) + str(draw.randrange(9)) for _ in range(40))
    rows = [(i, kind(["sun", "tree", "river"]), "clean") for i in range(4000)] + [(4000 + i, kind(["slur", "curse", "hate"]), "toxic") for i in range(3)]
    rows += [(5000 + i, kind(["buy", "click", "cheap"]), "low") for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    got = op8_mixing.mix(table.select("doc_id", "text"), table.select("doc_id", "domain"))
    rate = {r.doc_id: r.rate for r in got.collect()}
    assert all(rate[4000 + i] == 0 for i in range(3)) and all(rate[i] > 0 for i in range(4000))


def test_long_texts_are_counted_once_read(spark):
    docs = spark.createDataFrame([(1, "word " * 3000), (1, "word " * 3000), (2, "é" * 9000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in op1_tokens.count_tokens(docs, chunk=512, overlap=4).collect())
    whole = sorted((r.doc_id, r.n_tokens) for r in op1_tokens.count_tokens(docs, chunk=1 << 20).collect())
    assert got == whole
