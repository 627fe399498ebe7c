"""The trees and their threshold learn from every labelled proposal."""

from pyspark.sql import functions as F

from quantloom.llm import op9_pii


def test_every_labelled_proposal_is_learned_from(spark, monkeypatch):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail m"), F.col("id").cast("string"), F.lit("@host.org or 10.1.2.3, not 10.1.2.999; write to me (at) host (dot) org")).alias("text"))
    rows = op9_pii.proposed(docs)
    labelled = op9_pii.candidates(rows).where("label IS NOT NULL").count()
    assert labelled > 20000
    seen = []

    class Stop(Exception):
        pass

    class Spy:
        def __init__(self, **kw):
            pass

        def fit(self, d):
            seen.append(d.count())
            raise Stop

    monkeypatch.setattr(op9_pii, "GBTClassifier", Spy)
    try:
        op9_pii.selected(rows)
    except Stop:
        pass
    assert seen and abs(seen[0] / labelled - 0.75) < 0.02
