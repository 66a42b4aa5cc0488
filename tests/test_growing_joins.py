"""Joins of tables that grow with the input gather none of them on the driver, though the test tables are small enough for it."""

from __future__ import annotations

import pytest
from plans import all_plans

from lumatwin.plans import catalog


@pytest.mark.parametrize("name", ["j08_near_pairs_r6", "j08_near_pairs_r12", "j09_near_pairs_multi", "f02_similarity_score", "i11_threshold_sweep", "i11_threshold_groups", "g01_near_groups_r8", "g01_near_groups_strict_r6", "g03_two_tier", "j16_tuner_groups"])
def test_near_values_and_groups_are_joined_by_sorting(spark, tiny, monkeypatch, name):
    found = all_plans(monkeypatch, lambda: catalog.queries()[name](spark, tiny))
    assert any("SortMergeJoin" in p for p in found)
    assert not [p for p in found if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("name", ["a04_group_summary", "a05_group_details", "k05_new_groups", "k05_new_members", "i03_rebuilt"])
def test_what_is_made_of_groups_is_joined_by_sorting(spark, tiny, monkeypatch, name):
    monkeypatch.setattr("lumatwin.operators.grouping.near_groups", lambda spark, files, radius, **_: files.select("file_id").withColumns({"group_no": files.file_id, "confidence": files.file_id * 1.0}).select("group_no", "file_id", "confidence"))
    found = all_plans(monkeypatch, lambda: catalog.queries()[name](spark, tiny))
    assert not [p for p in found if "BroadcastHashJoin" in p]
