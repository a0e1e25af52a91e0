"""Queries of the text operators and the SQL that gives the same rows."""

from __future__ import annotations

from lumenfield.llm import chat, decontaminate, exact, langid, lines, ordinal, packing, simhash, substrings

QUERIES = {
    "op1_quality_classifier": ordinal.op1_quality_classifier,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_language_id": langid.op5_language_id,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_suffix_array_dedup": substrings.op9_suffix_array_dedup,
    "op10_toxicity": ordinal.op10_toxicity,
}
ORACLES = {"op4_chat_formatting": chat.ORACLE, "op7_exact_dedup": exact.ORACLE, "op8_line_dedup": lines.ORACLE}
