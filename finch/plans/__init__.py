"""Registered queries (Spark) and their DuckDB oracle SQL, collected per area."""

from __future__ import annotations

import importlib

_MODULES = ("retrieval", "corpus", "transactions", "pages", "links", "prompts")


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"{__name__}.{m}")
        out.update(getattr(mod, attr, {}))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLE")
