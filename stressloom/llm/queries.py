"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from stressloom.llm import decontaminate, language_model, line_dedup, manifest, mixing, near_dups, pieces, pii, quality, tokens, topk, toxicity, variants

QUERIES = {
    "op1_topk_search": topk.query,
    "op2_decontamination": decontaminate.query,
    "op3_lm_scoring": language_model.query,
    "op4_line_dedup": line_dedup.query,
    "op5_quality": quality.query,
    "op6_toxicity": toxicity.query,
    "op7_token_counts": tokens.query,
    "op8_mixing": mixing.query,
    "op9_near_duplicates": near_dups.query,
    "op10_pii": pii.query,
    "op11_merkle_manifest": manifest.query,
    "op12_spelling_variants": variants.query,
    "op13_sentencepiece": pieces.query,
    "op4_extended_dedup": line_dedup.query_extended,
}

SQL: dict[str, str] = {"op1_topk_search": topk.sql(), "op8_mixing": mixing.sql(), "op11_merkle_manifest": manifest.sql(), "op12_spelling_variants": variants.sql()}
