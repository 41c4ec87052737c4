"""The registered queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

from . import ann, jaccard_join, line_dedup, lm_score, mixing, packing, quality_classifier, quality_rules, substring_dedup, url_filter

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_nearest": ann.op4_nearest,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op3_line_dedup": line_dedup.oracle(),
    "op8_jaccard_join": jaccard_join.oracle(),
    "op5_quality_rules": quality_rules.oracle(),
    "op7_url_filter": url_filter.oracle(),
}
