"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["series_queries", "profile_queries", "cleaning_queries", "quality_queries", "graph_queries", "vector_queries", "stored_queries"]


def _modules():
    return [importlib.import_module(f"strandline.plans.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for module in _modules():
        twice = out.keys() & module.Q.keys()
        assert not twice, twice
        out.update(module.Q)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        assert module.SQL.keys() <= module.Q.keys(), module.SQL.keys() - module.Q.keys()
        out.update(module.SQL)
    return out
