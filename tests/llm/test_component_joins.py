"""Joins of tables that grow with the input gather none of them on the driver, though the test tables are small enough for it."""

from __future__ import annotations

from plans import all_plans

from lumatwin.llm import queries


def test_components_and_their_edges_are_joined_by_sorting(spark, tiny, monkeypatch):
    found = all_plans(monkeypatch, lambda: queries.tied_files(spark, tiny))
    assert len(found) > 5 and sum("SortMergeJoin" in p for p in found) >= 3
    assert not [p for p in found if "BroadcastHashJoin" in p]
