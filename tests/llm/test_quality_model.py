"""The distributed byte model of op5 against the same model in one process, and texts that differ only where bytes were once folded together."""

import random

import numpy as np

import corpus_pipeline
from quantloom.llm import op5_quality


def test_distributed_model_equals_the_one_of_one_process(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    found = op5_quality.grams(np.frombuffer(b"".join(data), np.uint8), offsets, 0, int(offsets[-1]))
    gram, n = np.unique(found, return_counts=True)
    want = op5_quality.KneserNey.fit(gram, n)
    got = {r.gram: r.logp for r in op5_quality.kneser_ney(spark.createDataFrame(list(zip(gram.tolist(), n.tolist())), "gram long, n long")).collect()}
    assert sorted(got) == want.keys[-1].tolist()
    logp = np.log2(want.p[-1])
    assert np.allclose([got[g] for g in want.keys[-1].tolist()], logp, atol=1e-5)
    total = np.add.reduceat(np.append(logp[np.searchsorted(gram, found)], 0.0), offsets[:-1])
    rows = {r.doc_id: r.perplexity for r in op5_quality.assess(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()}
    assert all(abs(np.log2(rows[i]) + total[i] / len(d)) < 1e-4 for i, d in enumerate(data) if d)


def test_no_bytes_are_folded_together(spark, sf):
    every = np.arange(256, dtype=np.uint8)
    assert len(set(op5_quality.grams(every, np.arange(257), 0, 256).tolist())) == 256
    draw = random.Random(3)
    letters = [chr(0x430 + i) for i in range(16)]
    words = ["".join(draw.choices(letters, weights=range(16, 0, -1), k=draw.randrange(2, 9))) for _ in range(400)]
    prose = lambda: " ".join(draw.choices(words, k=draw.randrange(150, 300)))
    odd = "".join(chr(ord(c) - 16 * draw.randrange(2)) if c != " " else c for c in prose())  # last bytes less by 16, or not
    docs = spark.createDataFrame([(i, prose(), "ru") for i in range(150)] + [(150, odd, "ru")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in op5_quality.assess(docs).where("not kept").collect()} == {150}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()} == set(range(150))
