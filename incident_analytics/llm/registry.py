"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import (bisector_clusters, bpe_table, filter_audit, fingerprint, mixing, near_dedup, pii, quality_pu, quality_rules,
               suffix_dedup, suffix_tree, token_files, toxicity)

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_quality_rules": quality_rules.query,
    "op3_near_dedup": near_dedup.query,
    "op4_suffix_tree": suffix_tree.query,
    "op5_toxicity": toxicity.query,
    "op6_bpe_table": bpe_table.query,
    "op7_pii": pii.query,
    "op8_quality_pu": quality_pu.query,
    "op9_fingerprint": fingerprint.query,
    "op10_mixing": mixing.query,
    "op11_bisector_clusters": bisector_clusters.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLES = {
    "op2_quality_rules": quality_rules.oracle(),
    "op11_bisector_clusters": bisector_clusters.oracle(),
    "op13_filter_audit": filter_audit.oracle(),
}
