"""Queries of the engine by name, and the same results in SQL where SQL can express them."""

from __future__ import annotations

import importlib
import re

MODULES = ("notes", "search", "index_graph", "similarity", "rollups", "evaluation", "streams")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _doubles(s) for m in _modules() for k, s in m.SQL.items()}


def _doubles(sql: str) -> str:
    """Number literals with a point as doubles, not decimals; quoted text stays."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    return "".join(p if k % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for k, p in enumerate(parts))
