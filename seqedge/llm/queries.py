"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from seqedge.llm import html, infill, jaccard, leaks, licenses, linededup, mixing, periods, pii, quality, sharding, tokens, urls

QUERIES = {f.__name__: f for f in (
    licenses.op1_license_paragraphs, mixing.op2_temperature_mix, leaks.op3_benchmark_leaks, jaccard.op4_grouped_prefix_join, html.op5_consensus_text,
    urls.op6_path_templates, quality.op7_line_quality, sharding.op8_extendible_shards, pii.op9_boosted_candidates, tokens.op10_token_counts,
    periods.op11_maximal_pairs, infill.op12_skip_list_infill, linededup.op13_cuckoo_line_dedup)}
ORACLE = {"op7_line_quality": quality.ORACLE_OP7}
