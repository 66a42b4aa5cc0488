"""Rows of reports on duplicates: pairs of an original and a duplicate, with fields that can be left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatwin.functions import media

#: The fields of a report in their order, with the names shown; the required ones can't be left out.
FIELDS = {
    "group_id": "Group ID", "original_path": "Original Path", "duplicate_path": "Duplicate Path", "tag": "Tag", "reason": "Reason", "similarity_score": "Similarity Score", "file_hash": "File Hash", "perceptual_hash": "Perceptual Hash",
    "file_size": "File Size", "original_size": "Original Size", "exif_match": "EXIF Match", "exif_differences": "EXIF Differences", "camera_make": "Camera Make", "camera_model": "Camera Model", "date_taken": "Date Taken",
    "resolution": "Resolution", "quality_score": "Quality Score", "compression_ratio": "Compression Ratio", "action_taken": "Action Taken", "action_timestamp": "Action Timestamp", "action_method": "Action Method",
    "created_date": "Created Date", "modified_date": "Modified Date", "confidence_level": "Confidence Level", "notes": "Notes",
}
REQUIRED = ("group_id", "original_path", "duplicate_path", "tag", "reason", "similarity_score", "action_taken")


def pairs(members: DataFrame, files: DataFrame, features: DataFrame, exif: DataFrame) -> DataFrame:
    """One row of FIELDS for each member that isn't its group's original (the smallest id of several). Groups without an original have no rows.

    members(group_id, file_id, role, similarity_score, notes); what isn't known is null.
    """
    known = files.join(features.select("file_id", "sha256", "phash"), "file_id", "left")
    first = members.where("role = 'original'").groupBy("group_id").agg(F.min("file_id").alias("o_id"))
    o = known.select(F.col("file_id").alias("o_id"), F.col("path").alias("original_path"), F.col("size").alias("original_size"), F.col("exif_dt").alias("o_dt"), F.col("camera_model").alias("o_camera"))
    rows = members.where("role <> 'original'").join(first, "group_id").join(o, "o_id").join(known, "file_id").join(exif.select("file_id", "camera_make"), "file_id", "left")
    dt = lambda c: media.present(F.col(c))
    day = lambda c: F.date_format(F.timestamp_micros((F.col(c) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss")
    score = F.coalesce(F.col("similarity_score"), F.lit(0.0)) * 100
    same_time, same_camera = dt("o_dt").eqNullSafe(dt("exif_dt")), media.same_camera(F.col("o_camera"), F.col("camera_model"))
    none = F.lit(None).cast("string")
    value = {
        "group_id": F.col("group_id"), "original_path": F.col("original_path"), "duplicate_path": F.col("path"), "tag": F.when(F.col("role") == "safe_duplicate", "safe_duplicate").otherwise("duplicate"),
        "reason": F.when(score > 99, "exact").otherwise("near"), "similarity_score": score, "file_hash": F.col("sha256"), "perceptual_hash": F.col("phash"), "file_size": F.col("size"), "original_size": F.col("original_size"),
        "exif_match": same_time & same_camera, "exif_differences": F.concat_ws(", ", F.when(~same_time, "time"), F.when(~same_camera, "camera")), "camera_make": F.col("camera_make"), "camera_model": F.col("camera_model"),
        "date_taken": F.when(F.col("exif_dt").between(0, 4e9), day("exif_dt")), "resolution": F.when(F.col("dims_w").isNotNull() & F.col("dims_h").isNotNull(), F.concat("dims_w", F.lit("x"), "dims_h")),
        "quality_score": F.col("similarity_score"), "compression_ratio": F.try_divide(F.col("size").cast("double"), F.nullif(media.resolution(F.col("dims_w"), F.col("dims_h")), F.lit(0))), "action_taken": F.lit("none"),
        "action_timestamp": F.lit(None).cast("double"), "action_method": none, "created_date": F.when(F.col("created_at").between(0, 4e9), day("created_at")), "modified_date": F.when(F.col("mtime").between(0, 4e9), day("mtime")),
        "confidence_level": F.col("similarity_score"), "notes": F.col("notes"),
    }
    return rows.select(*[value[f].alias(f) for f in FIELDS])


def chosen(fields: list[str] | None = None) -> list[str]:
    """The fields of a report in their order: those asked for and the required ones."""
    return [f for f in FIELDS if fields is None or f in fields or f in REQUIRED]


def as_text(rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Rows as a table of texts with the names shown: sizes with thousands separators, scores with two decimals, missing values empty."""
    form = {
        "file_size": F.format_number("file_size", 0), "similarity_score": F.format_string("%.2f", "similarity_score"),
        "action_timestamp": F.date_format(F.timestamp_micros((F.col("action_timestamp") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss"),
    }
    shown = lambda f: F.coalesce(F.when(F.col(f).isNotNull(), form.get(f, F.col(f).cast("string"))), F.lit(""))
    return rows.select(*[shown(f).alias(FIELDS[f]) for f in chosen(fields)])


def totals(rows: DataFrame) -> DataFrame:
    """One row per tag and reason: pairs, groups and bytes."""
    return rows.groupBy("tag", "reason").agg(F.count("*").alias("pairs"), F.countDistinct("group_id").alias("groups"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("size"))
