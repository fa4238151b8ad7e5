"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import (
    bit_sliced, bpe, exact_dedup, html_blocks, line_crf, mixing, near_dedup, quality_rules, spelling_groups, suffix_dedup,
    token_counts, token_files, whitening,
)


def registry() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_line_crf": line_crf.op2_line_crf,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_bpe": bpe.op5_bpe,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_token_files": token_files.op8_token_files,
        "op9_html_blocks": html_blocks.op9_html_blocks,
        "op10_near_dedup": near_dedup.op10_near_dedup,
        "op11_whitening": whitening.op11_whitening,
        "op12_bit_sliced": bit_sliced.op12_bit_sliced,
        "op13_spelling_groups": spelling_groups.op13_spelling_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op7_quality_rules": quality_rules.OP7_SQL,
        "op12_bit_sliced": bit_sliced.OP12_SQL,
        "op13_spelling_groups": spelling_groups.OP13_SQL,
    }
