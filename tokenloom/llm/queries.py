"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Module of each operator's query.
_MODULES = {
    "op1_secrets": "secrets",
    "op2_quality": "quality",
    "op3_toxicity": "toxicity",
    "op4_nearcopies": "nearcopies",
    "op5_chat": "chat",
    "op6_neighbours": "neighbours",
    "op7_lm": "lm",
    "op8_decontaminate": "decontaminate",
    "op9_sentencepieces": "sentencepieces",
    "op10_warc": "warc",
}


def queries() -> dict:
    """Query functions by name, in the operators' order."""
    return {name: getattr(importlib.import_module(f"tokenloom.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(importlib.import_module(f"tokenloom.llm.{module}"), "ORACLE_SQL", None)
        if sql is not None:
            out[name] = sql
    return out
