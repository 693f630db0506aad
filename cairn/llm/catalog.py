"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["op1_quality", "op2_minhash", "op3_rules", "op4_secrets", "op5_toxicity", "op6_language", "op7_topk", "op8_sharding", "op9_packing", "op10_sentencepiece", "sql_checks"]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"cairn.llm.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"cairn.llm.{m}").ORACLES
    return out
