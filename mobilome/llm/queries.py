"""The queries of this subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from mobilome.llm import (
    alignment, bpe, embedding_dedup, exact_dedup, html_text, maxent_lm, mixing, personal_data, quality, simhash, spelling, token_counts, toxicity,
)

QUERIES = {
    "op1_quality": quality.query,
    "op2_token_counts": token_counts.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_mix_sources": mixing.query,
    "op6_simhash": simhash.query,
    "op7_personal_data": personal_data.query,
    "op8_bpe": bpe.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_html_text": html_text.query,
    "op11_alignment": alignment.query,
    "op12_spelling": spelling.query,
    "op13_lm_scores": maxent_lm.query,
}

ORACLE_SQL = {
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
}
