"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL.

Each plan module fills ``QUERIES`` and ``ORACLES``; this module only puts them together.
"""

from __future__ import annotations

MODULES = ["text_plans", "table_plans", "rule_plans", "derived_plans"]


def _gather(attribute: str) -> dict:
    import importlib

    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"weir.plans.{name}"), attribute)
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
