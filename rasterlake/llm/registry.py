"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from rasterlake.llm import decontaminate, exact_dedup, html_text, itq, langid, line_dedup, packing, periodic, simhash, token_counts, tool_calls, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_subsequence_svm": toxicity.op1_subsequence_svm,
        "op2_language_profiles": langid.op2_language_profiles,
        "op3_layout_html": html_text.op3_layout_html,
        "op4_hilbert_packing": packing.op4_hilbert_packing,
        "op5_edit_aware_counts": token_counts.op5_edit_aware_counts,
        "op6_template_decontamination": decontaminate.op6_template_decontamination,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_itq_multi_index": itq.op8_itq_multi_index,
        "op9_simhash_pigeonring": simhash.op9_simhash_pigeonring,
        "op10_tool_call_linking": tool_calls.op10_tool_call_linking,
        "op11_progressive_exact_dedup": exact_dedup.op11_progressive_exact_dedup,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_periodic_runs": periodic.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op10_tool_call_linking": tool_calls.ORACLE_SQL,
        "op11_progressive_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
    }
