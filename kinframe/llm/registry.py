"""Queries and SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from kinframe.llm import bpe, chat_format, decontamination, embedding_dedup, hard_negatives, importance, jaccard_join, language_id, licenses, line_dedup, quality, sharding, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_sharding": sharding.op5_sharding,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_ngram_jaccard": jaccard_join.op8_ngram_jaccard,
    "op9_quality": quality.op9_quality,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_license_scans": licenses.op12_license_scans,
    "op13_importance_resampling": importance.op13_importance_resampling,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_license_scans": licenses.OP12_SQL,
    "op13_importance_resampling": importance.OP13_SQL,
}
