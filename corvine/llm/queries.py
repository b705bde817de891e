"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html_text, mixing, ngram_jaccard, ordinal_quality, pii, quality_rules, substring_dedup, token_files

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_quality_classifier": ordinal_quality.query,
    "op4_pii": pii.query,
    "op5_chat_formatting": chat.query,
    "op6_html_extraction": html_text.query,
    "op7_ngram_jaccard": ngram_jaccard.query,
    "op8_token_files": token_files.query,
    "op9_decontamination": decontaminate.query,
    "op10_mixing": mixing.query,
}
SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op5_chat_formatting": chat.SQL,
    "op7_ngram_jaccard": ngram_jaccard.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_mixing": mixing.SQL,
}
