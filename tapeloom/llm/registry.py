"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tapeloom.llm import (
    op1_decontamination,
    op2_chat,
    op3_sentencepiece,
    op4_simhash,
    op5_warc,
    op6_html_text,
    op7_language_id,
    op8_token_counts,
    op9_exact_dedup,
    op10_quality,
    op11_whitening,
    op12_pii,
    op13_hard_negatives,
)

QUERIES = {
    "op1_decontamination": op1_decontamination.op1_decontamination,
    "op2_chat": op2_chat.op2_chat,
    "op3_sentencepiece": op3_sentencepiece.op3_sentencepiece,
    "op4_simhash": op4_simhash.op4_simhash,
    "op5_warc": op5_warc.op5_warc,
    "op6_html_text": op6_html_text.op6_html_text,
    "op7_language_id": op7_language_id.op7_language_id,
    "op8_token_counts": op8_token_counts.op8_token_counts,
    "op9_exact_dedup": op9_exact_dedup.op9_exact_dedup,
    "op10_quality": op10_quality.op10_quality,
    "op11_whitening": op11_whitening.op11_whitening,
    "op12_pii": op12_pii.op12_pii,
    "op13_hard_negatives": op13_hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op1_decontamination": op1_decontamination.SQL,
    "op2_chat": op2_chat.SQL,
    "op5_warc": op5_warc.SQL,
    "op9_exact_dedup": op9_exact_dedup.SQL,
    "op13_hard_negatives": op13_hard_negatives.SQL,
}
