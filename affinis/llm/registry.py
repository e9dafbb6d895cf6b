"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from affinis.llm import bpe, chat, html_text, language_id, packing, quality, simhash, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_html_extraction": html_text.query,
    "op2_language_id": language_id.query,
    "op3_quality_rules": quality.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_chat_format": chat.query,
    "op6_exact_topk": topk.query,
    "op7_byte_bpe": bpe.query,
    "op8_best_fit_packing": packing.query,
    "op9_url_filter": url_filter.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLE_SQL = {
    "op5_chat_format": chat.SQL,
    "op6_exact_topk": topk.SQL,
    "op9_url_filter": url_filter.SQL,
}
