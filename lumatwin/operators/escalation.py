"""Promotion of duplicates that agree with their original in size, capture time and camera."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatwin.functions import media

LABELS = (("size_match", "file_size"), ("datetime_match", "datetime"), ("camera_match", "camera_model"))


def once(members: DataFrame) -> DataFrame:
    """One row per group and file; of repeated rows with different roles the most important counts: original, safe_duplicate, duplicate."""
    rank = F.when(F.col("role") == "original", 0).when(F.col("role") == "safe_duplicate", 1).otherwise(2)
    rest = [c for c in members.columns if c not in ("group_id", "file_id")]
    return members.groupBy("group_id", "file_id").agg(F.min(F.struct(rank.alias("rank"), *rest)).alias("m")).select("group_id", "file_id", *[f"m.{c}" for c in rest])


def criteria(a: str, b: str, tolerance_s: float = 2.0, check_camera: bool = True) -> dict[str, Column]:
    """The three criteria for columns named <prefix>size, exif_dt and camera_model of an original and a duplicate.

    Sizes must be equal and above 0. Times must both be known and at most tolerance_s apart; two unknown ones pass only without the camera
    check. Cameras must be equal but for case and blanks, or both unknown.
    """
    size_a, size_b = F.col(a + "size"), F.col(b + "size")
    dt_a, dt_b = media.present(F.col(a + "exif_dt")), media.present(F.col(b + "exif_dt"))
    times = F.when(dt_a.isNotNull() & dt_b.isNotNull(), F.abs(dt_a - dt_b) <= tolerance_s).when(dt_a.isNull() & dt_b.isNull(), F.lit(not check_camera)).otherwise(False)
    cameras = media.same_camera(F.col(a + "camera_model"), F.col(b + "camera_model")) if check_camera else F.lit(True)
    return {"size_match": F.coalesce((size_a == size_b) & (size_a > 0), F.lit(False)), "datetime_match": times, "camera_match": cameras}


def escalate(members: DataFrame, files: DataFrame, tolerance_s: float = 2.0, check_camera: bool = True) -> DataFrame:
    """One row per duplicate of a group that has an original: the criteria it meets and its new role.

    members(group_id, file_id, role), files(file_id, size, exif_dt, camera_model). Of several originals the smallest id counts;
    groups whose original has no files row, and duplicates without one, aren't judged. Other roles stay as they are.
    """
    known = files.select("file_id", "size", "exif_dt", "camera_model")
    first = members.where("role = 'original'").groupBy("group_id").agg(F.min("file_id").alias("original_id"))
    side = lambda p: known.select(*[F.col(c).alias(p + c) for c in known.columns])
    rows = members.where("role = 'duplicate'").select("group_id", "file_id").join(first, "group_id")
    rows = rows.join(side("o_"), F.col("original_id") == F.col("o_file_id")).join(side("d_"), F.col("file_id") == F.col("d_file_id"))
    rows = rows.withColumns(criteria("o_", "d_", tolerance_s, check_camera))
    met = F.concat_ws(" + ", *[F.when(F.col(c), label) for c, label in LABELS])
    all_met = F.col("size_match") & F.col("datetime_match") & F.col("camera_match")
    return rows.select(
        "group_id", "file_id", "original_id", "size_match", "datetime_match", "camera_match", F.when(met == "", "no_match").otherwise(met).alias("criteria"), F.when(all_met, "safe_duplicate").otherwise("duplicate").alias("new_role")
    )


def summarise(results: DataFrame) -> DataFrame:
    """One row: judged and promoted duplicates, the rate, duplicates by the exact set of criteria met, and groups with a promotion."""
    s, d, c = (F.col(n) for n in ("size_match", "datetime_match", "camera_match"))
    exclusive = {
        "all_criteria": s & d & c, "size_and_datetime": s & d & ~c, "size_and_camera": s & ~d & c, "datetime_and_camera": ~s & d & c,
        "size_match_only": s & ~d & ~c, "datetime_match_only": ~s & d & ~c, "camera_match_only": ~s & ~d & c, "no_criteria": ~s & ~d & ~c,
    }
    safe = F.col("new_role") == "safe_duplicate"
    rate = F.coalesce(F.try_divide(F.count_if(safe), F.count("*")), F.lit(0.0))
    return results.agg(
        F.count("*").alias("total_analyzed"), F.count_if(safe).alias("safe_duplicates_found"), rate.alias("escalation_rate"), *[F.count_if(x).alias(n) for n, x in exclusive.items()], F.countDistinct(F.when(safe, F.col("group_id"))).alias("groups_affected")
    )


def apply(members: DataFrame, results: DataFrame) -> DataFrame:
    """members with the promoted ones' role and notes, by group and file; the others unchanged."""
    up = results.where("new_role = 'safe_duplicate'").select("group_id", "file_id", F.concat(F.lit("escalated: "), "criteria").alias("_notes"))
    rows = members.join(up, ["group_id", "file_id"], "left")
    hit = F.col("_notes").isNotNull() & (F.col("role") == "duplicate")
    return rows.withColumns({"role": F.when(hit, "safe_duplicate").otherwise(F.col("role")), "notes": F.when(hit, F.col("_notes")).otherwise(F.col("notes"))}).drop("_notes")


def role_status(members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: members by role, stored groups, those with a promoted member, and the promoted share of duplicates in percent."""
    n = lambda r: F.count_if(F.col("role") == r)
    share = n("safe_duplicate") / F.greatest(F.lit(1), n("duplicate") + n("safe_duplicate")) * 100
    counts = members.agg(n("original").alias("original"), n("duplicate").alias("duplicate"), n("safe_duplicate").alias("safe_duplicate"), share.alias("safe_percentage"))
    ids = groups.select(F.col("id").alias("group_id")).distinct()
    with_safe = members.where("role = 'safe_duplicate'").join(ids, "group_id", "left_semi").agg(F.countDistinct("group_id").alias("groups_with_safe"))
    return counts.join(F.broadcast(with_safe)).join(F.broadcast(ids.agg(F.count("*").alias("total_groups"))))  # one row each
