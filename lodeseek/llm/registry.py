"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from lodeseek.llm import queries as q

QUERIES = {
    "op1_exact_dedup": q.op1_exact_dedup,
    "op2_lm_scores": q.op2_lm_scores,
    "op3_pii": q.op3_pii,
    "op4_line_dedup": q.op4_line_dedup,
    "op5_setsketch": q.op5_setsketch,
    "op6_license_scan": q.op6_license_scan,
    "op7_token_files": q.op7_token_files,
    "op8_mixing": q.op8_mixing,
    "op9_bpe": q.op9_bpe,
    "op10_quality_rules": q.op10_quality_rules,
}

ORACLE_SQL = {
    "op1_exact_dedup": q.OP1_SQL,
    "op5_setsketch": q.OP5_SQL,
    "op8_mixing": q.OP8_SQL,
}
