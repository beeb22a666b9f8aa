"""Queries of this subpackage and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from strandline.llm import bpe, decontamination, embedding_dedup, filter_audit, hard_negatives, packing, pii, quality, sharding, simhash, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_simhash": simhash.op2_simhash,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_pii": pii.op8_pii,
    "op9_sharding": sharding.op9_sharding,
    "op10_bpe": bpe.op10_bpe,
    "op11_decontamination": decontamination.op11_decontamination,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.SQL, "op3_substring_dedup": substring_dedup.SQL, "op11_decontamination": decontamination.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_filter_audit": filter_audit.SQL}
