"""Conversation repair against an automaton over all edits, hand-made rows and the comparison SQL."""

import hashlib
import itertools
import random

import duckdb
import pytest

from quantloom.llm import op12_conversation as op12

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
COSTS = {"D": 4, "I": 3, "R": 3, "K": 0}


def brute(turns):
    """(cost, audit) by a walk over (turns left, phase), the least string of each."""
    best = {}

    def better(key, cost, audit):
        if key not in best or (cost, audit) < best[key]:
            best[key] = (cost, audit)
            return True
        return False

    n = len(turns)
    for i in range(n, -1, -1):
        for p in range(4):
            if i == n and p in (0, 3):
                better((i, p), 0, "")
            if i < n:
                x = turns[i]
                role, must, cut = x & 3, x & 4, 3 if x & 8 else 0
                c, a = best[i + 1, p]
                better((i, p), c + 4, "D" + a)
                if not must:
                    q = STEP[p].get({0: "s", 1: "u", 2: "a", 3: "?"}[role])
                    if q is not None:
                        c, a = best[i + 1, q]
                        better((i, p), c + cut, "K" + a)
                    c, a = best[i + 1, 3 if p == 2 else 2]
                    better((i, p), c + cut + 3, "R" + a)
            best.setdefault((i, p), (10**9, ""))
        for _ in range(4):
            for p in range(4):
                c, a = best[i, 3 if p == 2 else 2]
                better((i, p), c + 3, "I" + a)
    return best[0, 0]


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_alignment_equals_the_automaton(block):
    kinds = [r | f for r in range(4) for f in (0, 4, 8)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert op12.repair(bytes(turns), block) == brute(turns), turns
    draw = random.Random(5)
    for _ in range(150):
        turns = [draw.choice([0, 1, 1, 2, 2, 3]) | draw.choice([0, 0, 0, 4, 8]) for _ in range(draw.randrange(4, 40))]
        assert op12.repair(bytes(turns), block) == brute(turns), turns


def test_long_conversation_in_blocks():
    draw = random.Random(6)
    turns = bytes(draw.choice([1, 2, 1, 2, 0, 3]) | draw.choice([0, 0, 0, 4, 8]) for _ in range(900))
    assert op12.repair(turns) == brute(turns)


def rows(spark, values):
    return spark.createDataFrame(values, "conv_id long, turn long, role string, text string")


def compare(spark, table):
    got = op12.repaired(table)
    db = duckdb.connect()
    db.register("conversations", table.toArrow())
    names = [d[0] for d in db.execute(op12.sql()).description]
    want = sorted(map(repr, db.execute(op12.sql()).fetchall()))
    assert names == got.columns
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    return {r["conv_id"]: r for r in got.collect()}


def test_equals_sql_on_the_smallest_table(spark, sf):
    assert len(compare(spark, spark.read.parquet(f"{sf}/conversations.parquet"))) > 0


def test_hard_rows(spark):
    draw = random.Random(7)
    values = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(["Hm.", "so", "", None, " \t", "Ünd!", "x" * 5000 + "?"])) for c in range(60) for t in range(draw.randrange(1, 12))]
    values += [(None, None, None, None), (None, 3, "user", "A."), (61, 1, "user", "Same."), (61, 1, "user", "Same."), (62, None, "user", "No turn."), (62, 9, "assistant", "b")]
    values += [(70, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    got = compare(spark, rows(spark, values).selectExpr("*", "1 AS audit", "2 AS cost", "'x' AS digest"))
    assert got[61]["duplicate"] >= 1 or got[61]["blank"] >= 1 or got[61]["audit"] == ""
    assert len(got[70]["audit"]) >= 200


def test_all_rows_dropped_and_empty_table(spark):
    gone = next((c, t) for c in range(1000) for t in range(3) if op12.__name__ and __import__("zlib").crc32(f"{c}:{t}".encode()) % 20 == 0)
    (row,) = op12.repaired(rows(spark, [(*gone, "user", "Hm.")])).collect()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert op12.repaired(rows(spark, [])).count() == 0
