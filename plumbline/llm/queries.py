"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, chat, decontaminate, html_text, language, licenses, lm_scoring, minhash, mixing, negatives, quality, suffixes, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_chat_format": chat.op6_chat_format,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_language_id": language.op13_language_id,
}
ORACLE_SQL = {
    "op1_license_scan": licenses.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op7_near_duplicates": minhash.OP7_SQL,
    "op8_html_text": html_text.OP8_SQL,
    "op9_decontamination": decontaminate.OP9_SQL,
    "op10_suffix_dedup": suffixes.OP10_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
