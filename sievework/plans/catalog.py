"""All queries of the engine by name, with the SQL that they are held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("layers", "evaluation", "evidence", "operations", "serving")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"sievework.plans.{m}").Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"sievework.plans.{m}").SQL.items()}
