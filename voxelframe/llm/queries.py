"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from voxelframe.llm import ann, bpe, decontaminate, linededup, lm, neardup, substring, suffix, tokenfile, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_token_files": tokenfile.op2_token_files,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_substring_dedup": substring.op5_substring_dedup,
    "op6_bpe_round_trip": bpe.op6_bpe_round_trip,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_nearest": ann.op8_nearest,
    "op9_suffix_dedup": suffix.op9_suffix_dedup,
    "op10_lm_score": lm.op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": linededup.ORACLE}
