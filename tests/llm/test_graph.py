"""Components in one task and by contraction against union-find."""

import random

from quantloom.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted((x, find(x)) for x in root)


def test_both_ways_are_equal(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(draw.randrange(90), draw.randrange(90)) for _ in range(60)] + [(5, 5), (7, 8), (8, 7), (-3, 2**62)]
    table = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 1 << 20):
        assert sorted(map(tuple, components(table, few).collect())) == brute(edges)
    assert components(table.limit(0), 0).count() == components(table.limit(0)).count() == 0
