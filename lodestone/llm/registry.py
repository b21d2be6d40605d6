"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_near_dedup": "minhash",
    "op2_pii": "pii",
    "op3_decontaminate": "decontaminate",
    "op4_near_vectors": "vectors",
    "op5_line_dedup": "line_dedup",
    "op6_context_tree": "context_tree",
    "op7_pieces": "pieces",
    "op8_language": "language",
    "op9_token_records": "token_records",
    "op10_quality": "quality",
    "op11_resample": "targeting",
    "op12_toxicity": "toxicity",
    "op13_fill_middle": "fill_middle",
}

_SQL = {
    "op3_decontaminate": ("decontaminate", "OP3_SQL"),
    "op4_near_vectors": ("vectors", "OP4_SQL"),
    "op5_line_dedup": ("line_dedup", "OP5_SQL"),
    "op11_resample": ("targeting", "OP11_SQL"),
    "op13_fill_middle": ("fill_middle", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"lodestone.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lodestone.llm.{module}"), sql) for name, (module, sql) in _SQL.items()}
