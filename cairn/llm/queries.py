"""The queries of the training-data operators, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from cairn.llm import attention_lm, best_fit, byte_bpe, interleaved, label_shards, language_id, lsh_forest, lz_fingerprint, paragraph_dedup, pii_feistel

QUERIES = {
    "op1_paragraph_dedup": paragraph_dedup.query,
    "op2_lz_fingerprint": lz_fingerprint.query,
    "op3_pii_feistel": pii_feistel.query,
    "op4_interleaved_documents": interleaved.query,
    "op5_language_id": language_id.query,
    "op6_attention_lm": attention_lm.query,
    "op7_best_fit_packing": best_fit.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_label_shards": label_shards.query,
    "op10_lsh_forest_join": lsh_forest.query,
}

ORACLE_SQL: dict[str, str] = {}
