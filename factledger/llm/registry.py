"""The queries of this package and their DuckDB twins."""

from __future__ import annotations

from factledger.llm import embedding_dedup, html_extract, mixing, packing, quality_classifier, quality_rules, seen_lines, simhash, substring_dedup, suffix_dedup, token_align, topk, url_filter


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_mixing": mixing.op6_mixing,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_simhash": simhash.op9_simhash,
        "op10_exact_topk": topk.op10_exact_topk,
        "op11_seen_lines": seen_lines.op11_seen_lines,
        "op12_token_align": token_align.op12_token_align,
        "op13_embedding_dedup": embedding_dedup.op13_embedding_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op4_quality_rules": quality_rules.ORACLE,
        "op5_url_filter": url_filter.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op10_exact_topk": topk.ORACLE,
        "op11_seen_lines": seen_lines.ORACLE,
        "op13_embedding_dedup": embedding_dedup.ORACLE,
    }
