"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, cnn, decontaminate, html_extract, jaccard, line_dedup, lm, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_quality_rules": quality_rules.query,
    "op3_line_dedup": line_dedup.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality_cnn": cnn.query,
    "op6_lm_score": lm.query,
    "op7_jaccard_join": jaccard.query,
    "op8_toxicity": toxicity.query,
    "op9_decontaminate": decontaminate.query,
    "op10_bpe": bpe.query,
}
ORACLE = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op6_lm_score": lm.ORACLE,
    "op7_jaccard_join": jaccard.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}
