"""Queries of this folder, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from veilspark.llm import chat_format, decontaminate, html_density, near_dup, sentencepiece_viterbi, token_count, token_store, topk, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_chat_format": chat_format.query,
    "op3_near_duplicates": near_dup.query,
    "op4_toxicity": toxicity.query,
    "op5_exact_topk": topk.query,
    "op6_decontamination": decontaminate.query,
    "op7_sentencepiece": sentencepiece_viterbi.query,
    "op8_html_text": html_density.query,
    "op9_token_store": token_store.query,
    "op10_token_counts": token_count.query,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.ORACLE,
    "op5_exact_topk": topk.ORACLE,
    "op6_decontamination": decontaminate.ORACLE,
}
