"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import best_fit_packing, language_filters, license_scan, mixing, pii_feistel, quality_rules, repeat_index, secret_ledger, simhash_pigeonhole, topk_histogram

QUERIES = {
    "op1_pii_feistel": pii_feistel.op1_pii_feistel,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_repeat_index": repeat_index.op3_repeat_index,
    "op4_language_filters": language_filters.op4_language_filters,
    "op5_simhash_pigeonhole": simhash_pigeonhole.op5_simhash_pigeonhole,
    "op6_best_fit_packing": best_fit_packing.op6_best_fit_packing,
    "op7_mixing": mixing.op7_mixing,
    "op8_secret_ledger": secret_ledger.op8_secret_ledger,
    "op9_topk_histogram": topk_histogram.op9_topk_histogram,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_secret_ledger": secret_ledger.ORACLE,
    "op9_topk_histogram": topk_histogram.ORACLE,
}
