"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

#: Query to the module that has it.
MODULES = {
    "op1_minhash_dedup": "minhash",
    "op2_warc": "warc",
    "op3_mix": "mixing",
    "op4_bpe": "bpe",
    "op5_token_shards": "shards",
    "op6_quality_rules": "rules",
    "op7_secrets": "secrets",
    "op8_quality_model": "boosting",
    "op9_neighbours": "neighbours",
    "op10_licenses": "licenses",
}


def queries() -> dict:
    return {name: getattr(import_module(f"stepforge.llm.{module}"), name) for name, module in MODULES.items() if find_spec(f"stepforge.llm.{module}")}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"stepforge.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items() if find_spec(f"stepforge.llm.{module}")}
    return {name: sql for name, sql in found.items() if sql}
