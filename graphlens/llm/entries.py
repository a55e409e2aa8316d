"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from graphlens.llm import collocations, decontam, dedup_suffix, filter_audit, html_extract, language_id, lm_score, mixing, near_dup, pii, quality, token_counts, topk

QUERIES = {
    "op1_extract_text": html_extract.op1_extract_text,
    "op2_language_id": language_id.op2_language_id,
    "op3_find_pii": pii.op3_find_pii,
    "op4_topk": topk.op4_topk,
    "op5_remove_repeats": dedup_suffix.op5_remove_repeats,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_collocations": collocations.op12_collocations,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLE_SQL = {
    "op4_topk": topk.OP4_SQL,
    "op8_decontaminate": decontam.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_near_duplicates": near_dup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
}
