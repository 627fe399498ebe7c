"""Benchmark items with a changed word or a clipped tail are found; half an item is not."""

import random

import numpy as np

from quantloom.llm import op3_decontamination


def test_edited_and_clipped_items(spark):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [draw.choices(vocabulary, k=n) for n in (59, 15, 24, 59, 40, 30)]
    around = lambda words: " ".join([*draw.choices(vocabulary, k=draw.randrange(90)), *words, *draw.choices(vocabulary, k=draw.randrange(90))])
    texts, wanted = [], []
    for k, item in enumerate(items[:3]):
        for at in range(len(item)):
            texts.append(around([*item[:at], "changed", *item[at + 1:]]))
            wanted.append(k)
        texts.append(around(item[:len(item) - min(8, len(item) // 3)]))
        wanted.append(k)
    texts += [around(items[0][:30]), around(items[0][29:]), around([]), around(draw.sample(items[0], 59))]
    wanted += [None] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r.hits for r in op3_decontamination.contaminated(docs, bench, name="hits").collect()}
    assert [got[i] for i in range(len(texts))] == [[] if w is None else [w] for w in wanted]


def test_aligned_is_the_longest_common_subsequence():
    draw = np.random.default_rng(4)
    for _ in range(100):
        a, b = (draw.integers(0, 5, draw.integers(0, 30)).astype(np.uint64) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert op3_decontamination.aligned(a, b) == table[-1, -1]
