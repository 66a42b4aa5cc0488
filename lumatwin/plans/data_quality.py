"""Queries of the operators that clean data before anything else: p3."""

from __future__ import annotations

from lumatwin.operators import timestamps


def queries() -> dict:
    return {"p3_found": timestamps.capture_instants, "p3_zone_history": timestamps.zone_history, "p3_offset_history": timestamps.offset_history}


def oracle_sql() -> dict[str, str]:
    return {}
