"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import blocks, html, mixing, packing, quality, rules, secrets, simhash, suffixes, topk

QUERIES = {
    "op1_mix_entropy_balancing": mixing.op1,
    "op2_suffix_sort_dedup": suffixes.op2,
    "op3_fixed_block_dedup": blocks.op3,
    "op4_secret_randomness_battery": secrets.op4,
    "op5_topk_threshold_algorithm": topk.op5,
    "op6_importance_resampling": quality.op6,
    "op7_quality_rule_ledger": rules.op7,
    "op8_cost_balanced_packing": packing.op8,
    "op9_simhash_bk_trees": simhash.op9,
    "op10_html_crf": html.op10,
}
ORACLES: dict[str, str] = {
    "op5_topk_threshold_algorithm": topk.OP5_SQL,
    "op7_quality_rule_ledger": rules.OP7_SQL,
}
