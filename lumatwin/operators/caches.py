"""Stored entries of a cache, and rows of thumbnails: added, used, removed, summed up. Tables are snapshots: every function returns the next one.

entries(key, path, size, created_at, last_accessed, entry_type); thumbs(file_id, thumb_path, thumb_w, thumb_h, created_at, last_used_at).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import retention, storage


def add(entries: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """entries with new(key, path, size, entry_type) put in or in place of those of equal keys, made and used now. Null keys are no entries; of several new ones of a key the largest counts."""
    made = new.where("key IS NOT NULL").select("key", "path", "size", F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("last_accessed"), "entry_type")
    return storage.upsert(entries.select(*made.columns), made, ["key"])


def touch(entries: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """entries with the time of use of some keys set; keys that aren't there are ignored."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    rows = entries.join(hit, "key", "left")
    return rows.withColumn("last_accessed", F.when(F.col("_hit"), F.lit(float(now))).otherwise(F.col("last_accessed"))).select(*entries.columns)


def remove(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti").select(*entries.columns)


def clear(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty table, and one row on what went: cleared_entries, cleared_size_mb."""
    gone = entries.agg(F.count("*").alias("cleared_entries"), media.megabytes(F.coalesce(F.sum("size"), F.lit(0))).alias("cleared_size_mb"))
    return entries.limit(0), gone


def thumbs_asked(thumbs: DataFrame, asked: DataFrame, there: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """thumbs after files(file_id) were asked for: rows whose picture is there were used now; rows without one go, and a new row takes their place.

    there(thumb_path): the pictures that exist. new: rows as of thumbs that can be made for the files. Rows of files that weren't asked for stay as they are.
    """
    ask = asked.select("file_id").where("file_id IS NOT NULL").distinct()
    rows = thumbs.join(ask.withColumn("_asked", F.lit(True)), "file_id", "left").join(there.select("thumb_path").distinct().withColumn("_there", F.lit(True)), "thumb_path", "left")
    kept = rows.where("_asked IS NULL OR _there").withColumn("last_used_at", F.when(F.col("_asked"), F.lit(float(now))).otherwise(F.col("last_used_at"))).select(*thumbs.columns)
    made = new.join(ask, "file_id", "left_semi").join(kept.select("file_id"), "file_id", "left_anti")
    stamped = made.withColumns({"created_at": F.lit(float(now)), "last_used_at": F.lit(float(now))}).select(*thumbs.columns)
    return kept.unionByName(stamped)


def figures(files: DataFrame, now: float) -> DataFrame:
    """One row of cache figures with its times as texts, as they're kept: total_files, total_size_mb, reclaimable_size_mb, oldest_file_date, newest_file_date, fragmentation_level."""
    text = lambda c: F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss")
    f, r = retention.fragmentation(files, now), retention.reclaimable(files, now)
    both = f.join(F.broadcast(r.select(F.col("megabytes").alias("reclaimable_size_mb"))))  # one row each
    return both.select(F.col("files").alias("total_files"), media.megabytes(F.coalesce("size", F.lit(0))).alias("total_size_mb"), "reclaimable_size_mb", text("oldest").alias("oldest_file_date"), text("newest").alias("newest_file_date"), F.col("fragmentation").alias("fragmentation_level"))


#: What each trigger of a cleanup does: its mode, and whether it works towards a size.
TRIGGERS = {"app_start": "fast_sweep", "periodic_idle": "full_sweep", "size_cap_breach": "size_purge", "manual": "full_sweep"}


def cleanup(files: DataFrame, trigger: str, now: float, cap: float, percent: float = 80.0) -> DataFrame:
    """(path, size) that a cleanup takes: by age, by age and kind, or, if more than cap bytes are in use, oldest first (larger ones of an age first) down to so many percent of cap."""
    mode = TRIGGERS[trigger]
    if mode == "size_purge":
        total = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
        return retention.oldest_beyond(files, total, now, cap, percent)
    rows = retention.sweep(files, now).where("fast" if mode == "fast_sweep" else "full").select("path")
    return files.join(rows, "path", "left_semi").select("path", "size")
