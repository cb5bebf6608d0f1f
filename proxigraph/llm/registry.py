"""Queries of the training-data operators and, where SQL expresses them, DuckDB SQL for the same rows."""

from __future__ import annotations

from proxigraph.llm import decontaminate, edit_counts, language_id, line_dedup, near_dedup, packing, secret_scan, token_store, topk_search, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_secret_scans": secret_scan.op2_secret_scans,
    "op3_token_counts": edit_counts.op3_token_counts,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_exact_topk": topk_search.op5_exact_topk,
    "op6_packing": packing.op6_packing,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_token_store": token_store.op9_token_store,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_secret_scans": secret_scan.ORACLE,
    "op5_exact_topk": topk_search.ORACLE,
    "op7_url_filters": url_filter.ORACLE,
}
