"""Registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from quantloom.llm import op12_conversation
from quantloom.llm.op1_tokens import op1_token_counts
from quantloom.llm.op10_jaccard import op10_ngram_jaccard
from quantloom.llm.op11_embedding import op11_embedding_near_dedup
from quantloom.llm.op12_conversation import op12_conversation_repair
from quantloom.llm.op13_whitening import op13_embedding_whitening
from quantloom.llm.op2_language import op2_language_id
from quantloom.llm.op3_decontamination import op3_benchmark_decontamination
from quantloom.llm.op4_license import op4_license_scan
from quantloom.llm.op5_quality import op5_quality_rules
from quantloom.llm.op6_maxent import op6_maxent_lm
from quantloom.llm.op7_suffix import op7_suffix_dedup
from quantloom.llm.op8_mixing import op8_source_mixing
from quantloom.llm.op9_pii import op9_pii


def pipeline(spark, sf_dir: str):
    """All stages of the corpus pipeline at the repository top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_benchmark_decontamination, op4_license_scan, op5_quality_rules, op6_maxent_lm, op7_suffix_dedup, op8_source_mixing, op9_pii, op10_ngram_jaccard, op11_embedding_near_dedup, op12_conversation_repair, op13_embedding_whitening, pipeline)}
SQL: dict[str, str] = {"op12_conversation_repair": op12_conversation.sql()}
