"""The registered queries, by module: each has QUERIES and may have ORACLE."""

from __future__ import annotations

from importlib import import_module

MODULES = ("records", "catalog", "market", "pages", "captured")


def _gathered(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"stockroom.plans.{module}"), name, {})
    return found


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
