"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import decontaminate, html_extract, kneser_ney, license_scan, mixing, quality_rules, simhash, substring_dedup, token_count, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_simhash": simhash.op5_simhash,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_license_scan": license_scan.op10_license_scan,
}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op9_mixing": mixing.ORACLE}
