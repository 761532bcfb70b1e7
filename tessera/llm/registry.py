"""Queries of this subpackage, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from tessera.llm import bpe_query, exactdup_query, fim_query, html_query, langid_query, licenses_query, lmscore_query, media_query, mixing_query, neardup_query, topk_query, toxicity_query, whitening_query

QUERIES = {
    "op5_lm_score": lmscore_query.op5_lm_score,
    "op7_html_extraction": html_query.op7_html_extraction,
    "op1_media_columns": media_query.op1_media_columns,
    "op4_exact_top_k": topk_query.op4_exact_top_k,
    "op2_near_duplicates": neardup_query.op2_near_duplicates,
    "op8_toxicity": toxicity_query.op8_toxicity,
    "op6_language_id": langid_query.op6_language_id,
    "op3_bpe_encode": bpe_query.op3_bpe_encode,
    "op9_mix_sources": mixing_query.op9_mix_sources,
    "op10_license_scan": licenses_query.op10_license_scan,
    "op11_fill_in_middle": fim_query.op11_fill_in_middle,
    "op12_exact_substrings": exactdup_query.op12_exact_substrings,
    "op13_whitening": whitening_query.op13_whitening,
}
ORACLES = {"op4_exact_top_k": topk_query.SQL, "op9_mix_sources": mixing_query.SQL, "op11_fill_in_middle": fim_query.SQL}
