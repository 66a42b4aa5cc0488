"""All queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("data_quality", "grouping", "workflow", "upkeep", "fields", "storage", "ledger")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lumatwin.plans.{name}"), what)()
        if twice := out.keys() & part.keys():
            raise ValueError(f"two queries of one name: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict[str, str]:
    return _merged("oracle_sql")
