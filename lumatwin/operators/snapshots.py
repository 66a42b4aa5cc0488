"""Comparing a stored snapshot of files with a new listing, and carrying the stored tables over to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators.ordered import running


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, file_id, change): new, changed, unchanged or missing, for each path of either side.

    old(file_id, path, size, mtime), new(path, size, mtime); one row per path each.
    """
    a = old.select("path", "file_id", F.col("size").alias("size_a"), F.col("mtime").alias("mtime_a"), F.lit(True).alias("_a"))
    b = new.select("path", F.col("size").alias("size_b"), F.col("mtime").alias("mtime_b"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(media.changed(F.col("size_a"), F.col("mtime_a"), F.col("size_b"), F.col("mtime_b")), "changed").otherwise("unchanged")
    return a.join(b, "path", "full").select("path", "file_id", change.alias("change"))


def work(changes: DataFrame, features: DataFrame, thumbs: DataFrame) -> DataFrame:
    """changes with what each file needs: features or a thumbnail, because it's new, changed or has none."""
    has = lambda df, name: df.select("file_id").distinct().withColumn(name, F.lit(True))
    rows = changes.join(has(features, "_f"), "file_id", "left").join(has(thumbs, "_t"), "file_id", "left")
    fresh = F.col("change").isin("new", "changed")
    here = F.col("change") != "missing"
    return rows.select("path", "file_id", "change", (here & (fresh | F.col("_f").isNull())).alias("needs_features"), (here & (fresh | F.col("_t").isNull())).alias("needs_thumbnail"))


def stats(rows: DataFrame, seconds: float = 1.0) -> DataFrame:
    """One row of counts by change, of files processed, their speed and the share of reused ones. Each file counts once."""
    n = lambda c: F.count_if(F.col("change") == c)
    todo = F.count_if((F.col("change") != "missing") & (F.col("needs_features") | F.col("needs_thumbnail")))
    present = n("new") + n("changed") + n("unchanged")
    return rows.agg(
        n("new").alias("files_new"), n("changed").alias("files_changed"), n("unchanged").alias("files_unchanged"), n("missing").alias("files_missing"), present.alias("files_total"), todo.alias("files_processed"),
        (todo / F.lit(float(seconds))).alias("files_per_second"), F.coalesce(F.try_divide(n("unchanged"), present), F.lit(0.0)).alias("reuse_ratio"),
    )


def merge(old: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """The next snapshot: changed files take the new values and are active again, unchanged ones are only seen again, missing ones are marked, new ones get the next ids in path order.

    old(file_id, path, size, mtime, status, last_seen_at), new(path, size, mtime).
    """
    a = old.select("path", "file_id", *[F.col(c).alias(f"{c}_a") for c in ("size", "mtime", "status", "last_seen_at")])
    b = new.select("path", F.col("size").alias("size_b"), F.col("mtime").alias("mtime_b"), F.lit(True).alias("_b"))
    both = a.join(b, "path", "full")
    gone, differs = F.col("_b").isNull(), media.changed(F.col("size_a"), F.col("mtime_a"), F.col("size_b"), F.col("mtime_b"))
    status = F.when(gone & (F.col("status_a") == "active"), "missing").when(gone, F.col("status_a")).when(F.col("file_id").isNotNull() & ~differs, F.col("status_a")).otherwise("active")
    rows = both.select(
        "path", "file_id", F.when(gone, F.col("size_a")).otherwise(F.col("size_b")).alias("size"), F.when(gone, F.col("mtime_a")).otherwise(F.col("mtime_b")).alias("mtime"), status.alias("status"),
        F.when(gone, F.col("last_seen_at_a")).otherwise(F.lit(now)).alias("last_seen_at"),
    )
    return number_new(rows)


def number_new(rows: DataFrame) -> DataFrame:
    """rows with ids for those without one, above the largest, in path order."""
    top = rows.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("_top"))
    fresh = running(rows.where("file_id IS NULL"), [F.col("path")]).join(F.broadcast(top)).withColumn("file_id", F.col("_top") + F.col("place"))  # one row
    return rows.where("file_id IS NOT NULL").unionByName(fresh.select(*rows.columns))


def mark_missing(files: DataFrame, folder: str, started: float) -> DataFrame:
    """files with those under a folder that weren't seen since a scan began marked missing."""
    lost = F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/")) & (F.col("last_seen_at") < started) & (F.col("status") == "active")
    return files.withColumn("status", F.when(lost, "missing").otherwise(F.col("status")))


def lacking(files: DataFrame, *others: DataFrame) -> DataFrame:
    """The active files without a row in at least one of the other tables, once each."""
    live = files.where("status = 'active'").select("file_id")
    return reduce(DataFrame.union, [live.join(o.select("file_id"), "file_id", "left_anti") for o in others]).distinct()


def drop_of_changed(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Features or thumbnails without those of changed files."""
    return rows.join(changes.where("change = 'changed'").select("file_id"), "file_id", "left_anti")


def restorable(members: DataFrame, overrides: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What survives a rebuild: members whose file is active, and choices whose two files are, if they're different."""
    live = files.where("status = 'active'").select("file_id")
    kept = overrides.where("original_file_id <> auto_original_id").join(live, F.col("original_file_id") == F.col("file_id"), "left_semi").join(live, F.col("auto_original_id") == F.col("file_id"), "left_semi")
    return members.join(live, "file_id", "left_semi"), kept


def recommend(files: DataFrame, features: DataFrame, thumbs: DataFrame) -> DataFrame:
    """One row: active files, those lacking features or thumbnails, and which rescan fits: full_rebuild above half, missing_features above none, else delta_only."""
    has = lambda df, n: df.select("file_id").distinct().withColumn(n, F.lit(True))
    rows = files.where("status = 'active'").select("file_id").join(has(features, "f"), "file_id", "left").join(has(thumbs, "t"), "file_id", "left")
    counts = rows.agg(F.count("*").alias("total_files"), F.count_if(F.col("f").isNull()).alias("missing_features"), F.count_if(F.col("t").isNull()).alias("missing_thumbs"))
    half = F.col("total_files") * 0.5
    which = F.when((F.col("missing_features") > half) | (F.col("missing_thumbs") > half), "full_rebuild").when((F.col("missing_features") > 0) | (F.col("missing_thumbs") > 0), "missing_features").otherwise("delta_only")
    return counts.withColumn("recommended", which)


def feature_coverage(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in columns])
