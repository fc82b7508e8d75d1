"""Queries and SQL of the operators, and of the pipeline, by name."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, pii, quality_lm, suffix_dedup, toxicity

QUERIES = {
    "op1_pii": pii.query,
    "op2_embedding_near_dedup": embedding_dedup.query,
    "op3_mixing": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_quality": quality_lm.query,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_bpe": bpe.query,
    "op9_language_id": language_id.query,
    "op10_exact_dedup": exact_dedup.query,
}
SQL = {"op2_embedding_near_dedup": embedding_dedup.SQL, "op3_mixing": mixing.SQL, "op5_jaccard_join": jaccard_join.SQL, "op7_suffix_dedup": suffix_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL}
