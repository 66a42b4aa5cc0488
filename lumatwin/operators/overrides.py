"""Choices of an original made by hand: kept as a history, applied over the automatic choice.

overrides(override_id, group_id, original_file_id, auto_original_id, override_type, reason, created_at, is_active).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record(overrides: DataFrame, new: DataFrame, members: DataFrame) -> DataFrame:
    """The history with new choices added; a group's earlier ones become inactive. Choices of files outside their group are refused."""
    valid = new.join(members.select("group_id", F.col("file_id").alias("original_file_id")).distinct(), ["group_id", "original_file_id"], "left_semi")
    now = valid.groupBy("group_id").agg(F.max("override_id").alias("newest"))
    rows = overrides.unionByName(valid.withColumn("is_active", F.lit(True))).join(now, "group_id", "left")
    return rows.withColumn("is_active", F.col("is_active") & (F.col("newest").isNull() | (F.col("override_id") == F.col("newest")))).drop("newest")


def active(overrides: DataFrame) -> DataFrame:
    """The newest active choice of each group."""
    rest = [c for c in overrides.columns if c not in ("group_id", "created_at", "override_id")]
    newest = overrides.where("is_active").groupBy("group_id").agg(F.max(F.struct("created_at", "override_id", *rest)).alias("o"))
    return newest.select("group_id", "o.*")


def apply(auto: DataFrame, members: DataFrame, overrides: DataFrame) -> DataFrame:
    """(group_id, original_id, by_hand, conflict): the choice by hand where its file is still a member, else the automatic one.

    auto(group_id, original_id). conflict: none, differs (by hand and automatic choices differ), or gone (the chosen file isn't in the group).
    """
    chosen = active(overrides).select("group_id", F.col("original_file_id").alias("file_id"))
    here = members.select("group_id", "file_id").distinct().withColumn("here", F.lit(True))
    rows = auto.join(chosen.join(here, ["group_id", "file_id"], "left"), "group_id", "left")
    valid = F.coalesce(F.col("here"), F.lit(False))
    conflict = F.when(F.col("file_id").isNull(), "none").when(~valid, "gone").when(F.col("file_id") != F.col("original_id"), "differs").otherwise("none")
    return rows.select("group_id", F.when(valid, F.col("file_id")).otherwise(F.col("original_id")).alias("original_id"), valid.alias("by_hand"), conflict.alias("conflict"))


def set_roles(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """members of the chosen groups with the chosen file as original and all others as duplicates; other groups unchanged."""
    rows = members.join(chosen.select("group_id", F.col("original_id").alias("_original")), "group_id", "left")
    role = F.when(F.col("_original").isNull(), F.col("role")).when(F.col("file_id") == F.col("_original"), "original").otherwise("duplicate")
    return rows.withColumn("role", role).drop("_original")


def remove(overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """The history with the choices of some groups inactive."""
    gone = groups.select("group_id").distinct().withColumn("_gone", F.lit(True))
    return overrides.join(gone, "group_id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


def missing_originals(overrides: DataFrame, files: DataFrame) -> DataFrame:
    """Active choices whose file is missing or not active any more, with confidence 0 and what can be done."""
    live = files.where("status = 'active'").select(F.col("file_id").alias("original_file_id"))
    actions = F.array(F.lit("accept_auto"), F.lit("choose_new"), F.lit("remove_override"))
    return active(overrides).join(live, "original_file_id", "left_anti").select("group_id", "original_file_id", "auto_original_id", F.lit(0.0).alias("confidence"), F.array_join(actions, ",").alias("actions"))


def stats(overrides: DataFrame) -> DataFrame:
    """Counts of the history: in all, active, and active by type and by reason, as (what, name, n, percent)."""
    total = overrides.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))
    share = F.col("active") / F.greatest(F.lit(1), F.col("total")) * 100
    whole = total.select(F.lit("total").alias("what"), F.lit("all").alias("name"), F.col("total").alias("n"), F.lit(100.0).alias("percent")).union(total.select(F.lit("total"), F.lit("active"), "active", share))
    by = lambda c, what: overrides.where("is_active").groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n", F.lit(None).cast("double").alias("percent"))
    return whole.union(by("override_type", "type")).union(by("reason", "reason"))
