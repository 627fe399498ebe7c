"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
from llm import plain
from quantloom.llm import op5_quality
from quantloom.llm.common import documents, saved
from llm.test_operators import hard


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        verdict = {r.doc_id for r in op5_quality.assess(docs).where("kept").collect()} if name == "quality_rules" else None
        docs = saved(stage(spark, docs, sf))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            assert set(after) == verdict
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in plain.jaccard_groups(list(before.items()))}
        if name == "decontamination":
            assert not any(x in t for t in after.values() for x in items) and len(before) - len(after) <= 1 + sum(any(x in t for x in items) for t in before.values())
        if name == "personal_data":
            assert set(after) == set(before) and not any(plain.personal(t)[-1] for t in after.values())
        if name != "mixing":
            assert docs.columns == columns
    assert docs.columns == [*columns, "n_tokens", "rate"] and docs.where("rate <= 0").isEmpty()


def test_stages_bear_hard_rows(spark, sf):
    for table in (hard(spark), hard(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf).collect()


def test_registered():
    from __spark_entry__ import queries
    names = list(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
