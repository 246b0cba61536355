"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> (spark, sf_dir) -> DataFrame) and SQL (name -> text).
MODULES = ("flagship", "workspace", "graph", "refine", "facts", "rules", "stores", "more", "further")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"clausemill.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
