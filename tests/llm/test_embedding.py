"""Near-duplicate embeddings against all pairs, with groups of copies, hard rows and blocks."""

import math

import numpy as np
import pytest

from quantloom.llm import op11_embedding as op11

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    def good(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    vectors = [np.array(v, float) / np.linalg.norm(v) if label is not None and good(v) else None for _, v, label in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if vectors[i] is not None and vectors[j] is not None and rows[i][2] == rows[j][2] and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min([x for x in (least.get(find(i)), rows[i][0]) if x is not None], default=None)
    return sorted(((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def planted(seed, groups, size, noise, singles, dim=32, labels=3):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = draw.standard_normal(dim)
        for _ in range(size):
            rows.append((base + noise * draw.standard_normal(dim), g % labels))
    rows += [(draw.standard_normal(dim), int(draw.integers(labels))) for _ in range(singles)]
    draw.shuffle(rows)
    return [(i, [float(np.float32(x)) for x in v], int(label)) for i, (v, label) in enumerate(rows)]


def test_recall_over_groups_and_blocks(spark):
    rows = planted(1, 4, 40, 0.12, 150) + [(10_000 + i, v, label) for i, v, label in planted(2, 6, 10, 0.26, 0)]
    table = spark.createDataFrame(rows, KIND)
    want = brute(rows)
    total = sum(w[1] for w in want)
    assert total > 4000
    for block in (512, 7):  # the same whatever the size of the units
        got = result(op11.near_duplicates(table, block=block))
        assert all(g[1] <= w[1] for g, w in zip(got, want))
        assert sum(g[1] for g in got) >= 0.99 * total


def test_no_miss_gives_all_links(spark):
    rows = planted(3, 5, 12, 0.2, 60) + [(5000 + i, [1.0, 2.0, 3.0], 1) for i in range(70)] + [(6000, [2.0, 4.0, 6.0], 1), (6001, [1.0, 2.0, 3.0], 2)]
    rows += [(7000, None, 1), (7001, [0.0, 0.0], 1), (7002, [1.0, None], 1), (7003, [float("nan"), 1.0], 1), (7004, [], 1), (7005, [1.0, 2.0, 3.0], None), (None, None, None), (6000, [1.0, 2.0, 3.1], 1)]
    rows += [(None, [9.0, -9.0], 5), (None, [9.0, -9.0], 5), (None, [9.0, 9.0], 6), (8000, [9.0, 9.0], 6), (8001, [3e38, 3e38], 6), (8002, [1e-40, 1e-40], 6)]
    table = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "2 AS mark", "3 AS n_links")
    got = result(op11.near_duplicates(table, miss=1e-9))
    want = brute(rows)
    assert [g for g in got if g[0] is not None] == [w for w in want if w[0] is not None]
    assert len(got) == len(rows)
    assert (None, 1, None, True) in got and (None, 3, 8000, False) in got and (None, 0, None, True) in got


def test_registered_query_on_the_smallest_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(op11.op11_embedding_near_dedup(spark, sf)) == brute(rows)


def test_doubles_strings_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, [1.0, 0.1], "b"), (4, [1e200, 1e199], "b")]
    got = result(op11.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), miss=1e-9))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]
    assert op11.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_chain_is_one_component_and_shape_grows():
    n = 400
    assert (op11.lowest(n, np.arange(n - 1), np.arange(1, n)) == 0).all()
    assert (op11.lowest(n, np.arange(n - 1)[::-1], np.arange(1, n)[::-1]) == 0).all()
    assert (op11.lowest(4, np.array([1, 3]), np.array([3, 2])) == [0, 1, 1, 1]).all()
    for points in (10, 10_000, 10**9):
        bits, tables = op11.shape(points)
        assert (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables <= op11.MISS
    assert op11.exact_cosine(np.array([1.0, 0.0]), np.array([1.0, 1.0])) == pytest.approx(0.5**0.5)
