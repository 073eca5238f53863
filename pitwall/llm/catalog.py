"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import byte_cnn, kneser_ney, lines, minhash, mixing, packing, quality_rules, style_tree, suffix_dedup, webp

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_packing": packing.op2,
    "op3_byte_cnn": byte_cnn.op3,
    "op4_style_tree": style_tree.op4,
    "op5_suffix_dedup": suffix_dedup.op5,
    "op6_webp": webp.op6,
    "op7_kneser_ney": kneser_ney.op7,
    "op8_mixing": mixing.op8,
    "op9_minhash": minhash.op9,
    "op10_line_dedup": lines.op10,
}
ORACLES = {"op1_quality_rules": quality_rules.ORACLE, "op8_mixing": mixing.oracle()}
