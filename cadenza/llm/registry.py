"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from cadenza.llm import op1_urls, op2_tools, op3_substrings, op4_packing, op5_secrets, op6_lines, op7_minhash, op8_quality, op9_decontamination, op10_pii, op11_jaccard, op12_negatives, op13_filters

_MODULES = (op1_urls, op2_tools, op3_substrings, op4_packing, op5_secrets, op6_lines, op7_minhash, op8_quality, op9_decontamination, op10_pii, op11_jaccard, op12_negatives, op13_filters)

QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLE = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE is not None}
