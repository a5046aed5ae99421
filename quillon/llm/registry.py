"""Queries of this subpackage and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from quillon.llm import chat_format, decontaminate, embedding_dedup, hard_negatives, license_scan, line_dedup, minhash_dedup, mixing, piece_bpe, point_in_time, quality, suffix_dedup, token_files

_MODULES = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_token_files": token_files,
    "op3_line_dedup": line_dedup,
    "op4_mixing": mixing,
    "op5_quality": quality,
    "op6_license_scan": license_scan,
    "op7_decontaminate": decontaminate,
    "op8_embedding_dedup": embedding_dedup,
    "op9_suffix_dedup": suffix_dedup,
    "op10_chat_format": chat_format,
    "op11_hard_negatives": hard_negatives,
    "op12_point_in_time": point_in_time,
    "op13_piece_bpe": piece_bpe,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLE_SQL = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
