"""Copies and near copies of one text do not close the band of their language."""

import random

from quantloom.llm import op5_quality


def test_clean_texts_stay_beside_a_large_group_of_copies(spark):
    draw = random.Random(2)
    letters = "etaoinshrdlucmfwyp"
    vocabulary = ["".join(draw.choices(letters, weights=range(18, 0, -1), k=draw.randrange(2, 10))) for _ in range(3000)]
    prose = lambda: " ".join(draw.choices(vocabulary, k=draw.randrange(150, 400)))
    copy, near = prose(), prose().split()
    rows = [("clean", prose(), "en") for _ in range(140)] + [("clean", prose(), "fr") for _ in range(20)] + [("copy", copy, "fr") for _ in range(100)]
    rows += [("clean", prose(), "xx") for _ in range(3)] + [("copy", copy, "xx")] * 20
    rows += [("clean", prose(), "de") for _ in range(20)] + [("near", " ".join([*near[:i], draw.choice(vocabulary), *near[i + 1:]]), "de") for i in range(100)]
    rows += [("junk", "".join(draw.choices("xqzjkv #$%&", k=1500)), "fr")]
    got = {r.doc_id: r for r in op5_quality.assess(spark.createDataFrame([(i, t, g) for i, (_, t, g) in enumerate(rows)], "doc_id long, text string, lang string")).collect()}
    assert [i for i, (kind, _, _) in enumerate(rows) if got[i].kept != (kind == "clean") and kind in ("clean", "junk")] == []
