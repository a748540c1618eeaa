"""The queries of this folder, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestream.llm import best_fit_packing, chat_format, embedding_dedup, lm_scoring, near_dedup, quality_classifier, quality_rules, secret_scan, source_divergence, source_mixing, token_alignment, token_files, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_chat_format": chat_format.op2,
    "op3_minhash_near_dedup": near_dedup.op3,
    "op4_quality_classifier": quality_classifier.op4,
    "op5_embedding_near_dedup": embedding_dedup.op5,
    "op6_best_fit_packing": best_fit_packing.op6,
    "op7_source_mixing": source_mixing.op7,
    "op8_secret_scan": secret_scan.op8,
    "op9_token_files": token_files.op9,
    "op10_toxicity": toxicity.op10,
    "op11_lm_scoring": lm_scoring.op11,
    "op12_token_alignment": token_alignment.op12,
    "op13_source_divergence": source_divergence.op13,
}

#: The others are held against brute force, exact round trips or held-out labels in tests.
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op5_embedding_near_dedup": embedding_dedup.ORACLE,
    "op12_token_alignment": token_alignment.op12,
    "op13_source_divergence": source_divergence.ORACLE,
}
