"""All queries for the reference's operators, by operator id."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scoring", "labelling", "datasets", "texts", "streams", "extras", "training")


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"stepforge.plans.{name}").QUERIES
    return found


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
