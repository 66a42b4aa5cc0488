"""Queries on stored tables: upserts, replaced groups, lookups, agreement, top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import grouping, ordered, retention, storage
from lumatwin.plans import sqltext as S
from lumatwin.plans.grouping import _TIERS, records
from lumatwin.plans.workflow import _MEM, NOW, deleted, files, members, thumbs
from lumatwin.tables import latest, table


def upsert_features(spark, d):
    """A table of the features of odd versions, into which those of even versions are put where they're newer: the highest version of each file stays."""
    f = table(spark, d, "features").where("file_id IS NOT NULL").select("file_id", "fast_hash", "sha256", "phash", "dhash", "whash", "feature_ver")
    old = latest(f.where("feature_ver % 2 = 1"), "file_id", "feature_ver").select(*f.columns)
    new = f.where("feature_ver % 2 = 0").join(old.select("file_id", F.col("feature_ver").alias("_v")), "file_id", "left").where("_v IS NULL OR feature_ver > _v").drop("_v")
    return storage.upsert(old, new, ["file_id"], "feature_ver").select("file_id", "feature_ver", "sha256")


def upsert_members(spark, d):
    """A table of the members that aren't promoted, into which promoted ones are put: one row per group and file, that with the largest role."""
    m = table(spark, d, "group_members").select("group_id", "file_id", "role")
    safe = F.col("role") == "safe_duplicate"
    old = m.where(~safe).groupBy("group_id", "file_id").agg(F.max("role").alias("role"))
    return storage.upsert(old, m.where(safe), ["group_id", "file_id"])


def new_groups(spark, d):
    return storage.stored_groups(grouping.two_tier(spark, records(spark, d)), NOW)[0].drop("created_at")


def new_members(spark, d):
    return storage.stored_groups(grouping.two_tier(spark, records(spark, d)), NOW)[1].drop("notes")


def rebuilt(spark, d):
    """What a rebuild takes away and puts in its place, counted."""
    groups, rows = storage.stored_groups(grouping.two_tier(spark, records(spark, d)), NOW)
    parts = [("old_groups", table(spark, d, "dup_groups")), ("old_members", table(spark, d, "group_members")), ("new_groups", groups), ("new_members", rows)]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in parts]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def lookup_by_path(spark, d):
    """All current files looked up by the paths they ever had."""
    return storage.by_path(files(spark, d, "path", "size"), table(spark, d, "files").select("path"))


def exact_agreement(spark, d):
    """The stored exact groups against those found anew."""
    stored = members(spark, d).join(table(spark, d, "dup_groups").where("reason = 'exact_duplicates'").select(F.col("id").alias("group_id")).distinct(), "group_id", "left_semi")
    return storage.group_agreement(stored.select(F.col("group_id").alias("group_no"), "file_id"), grouping.exact_groups(records(spark, d)).select("group_no", "file_id"))


def health(spark, d):
    counts = files(spark, d, "path", "size").agg(F.count("*").alias("files"), media.megabytes(F.sum(F.length("path"))).alias("db_mb"), media.megabytes(F.sum(F.when(F.col("size") > 0, F.col("size")))).alias("cache_mb"))
    return storage.health(counts).select("files", "issues", "health")


def thumb_stats(spark, d):
    """Files with and without a thumbnail's stand-in."""
    f = files(spark, d, "status")
    return f.join(thumbs(spark, d).withColumn("t", F.lit(True)), "file_id", "left").groupBy("status").agg(F.count("t").alias("with_thumb"), F.count_if(F.col("t").isNull()).alias("without_thumb"))


def space_estimate(spark, d):
    """Bytes that deleting all but the original of each stored group would free, by group."""
    return members(spark, d).where("role <> 'original'").join(files(spark, d, "size"), "file_id").groupBy("group_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("reclaimable"))


def last_batches(spark, d):
    """The last ten deletions of each method."""
    rows = deleted(spark, d).select("method", "batch_id", "path", "size")
    return retention.newest(rows, 10, ["method"], [F.desc("batch_id"), F.asc("path")])


def delete_plan(spark, d):
    """What deleting all promoted duplicates would do, by method of deletion: nothing is deleted."""
    rows = members(spark, d).where("role = 'safe_duplicate'").select("file_id").distinct().join(files(spark, d, "size", "status"), "file_id")
    method = F.when(F.col("status") == "active", "quarantine").otherwise("skip")
    return rows.groupBy(method.alias("method")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.format_string("%.1f MB", media.megabytes(F.coalesce(F.sum("size"), F.lit(0)))).alias("text"))


def newest_files(spark, d):
    """The ten most recently changed files; ties by id."""
    return files(spark, d, "mtime").select("file_id", "mtime").orderBy(F.desc_nulls_last("mtime"), "file_id").limit(10)


def visible_selection(spark, d):
    """Ids and paths selected, in one list without merging the two."""
    m = members(spark, d).join(files(spark, d, "path"), "file_id")
    ids = m.where("role = 'safe_duplicate'").select(F.col("file_id").cast("string").alias("chosen"))
    return ids.unionByName(m.where("role = 'duplicate'").select(F.col("path").alias("chosen")))


def batch_names(spark, d):
    """names of deletion batches and folders, from the time of each file."""
    f = files(spark, d, "last_seen_at").select("file_id", F.timestamp_seconds(F.floor("last_seen_at")).alias("t"), F.floor("last_seen_at").alias("s"))
    return f.select("file_id", F.concat(F.lit("batch_"), "s").alias("batch"), F.date_format("t", "'deleted_'yyyyMMdd_HHmmss").alias("folder"))


def path_places(spark, d):
    """The place of each file in the order of paths, over the whole table."""
    return ordered.running(files(spark, d, "path"), [F.col("path"), F.col("file_id")]).select("file_id", "place")


def queries() -> dict:
    return {
        "k03_upsert_features": upsert_features, "k04_upsert_members": upsert_members, "k05_new_groups": new_groups, "k05_new_members": new_members, "i03_rebuilt": rebuilt, "p05_lookup_by_path": lookup_by_path, "j18_exact_agreement": exact_agreement, "f26_health": health,
        "a17_thumb_stats": thumb_stats, "a25_space_estimate": space_estimate, "w06_last_deletions": last_batches, "i10_delete_plan": delete_plan, "t02_newest_files": newest_files, "u06_selection_list": visible_selection, "f34_batch_names": batch_names, "t01_path_places": path_places,
    }


_C = f"WITH {S.CURRENT}"
_CM = f"{_C}, {_MEM}"
_NEW = _TIERS + ", tn AS (SELECT group_no * 2 + CASE tier WHEN 'near' THEN 1 ELSE 0 END group_id, tier, file_id, role, confidence FROM t)"


def oracle_sql() -> dict[str, str]:
    dele = f"{_C}, de AS (SELECT batch_id, path, size, CASE status WHEN 'deleted' THEN 'permanent' WHEN 'missing' THEN 'recycle' ELSE 'quarantine' END AS method FROM (SELECT file_id, min(batch_no) batch_id FROM batch_items GROUP BY 1) b JOIN cur ON cur.id = b.file_id)"
    return {
        "k03_upsert_features": "SELECT file_id, feature_ver, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1",
        "k04_upsert_members": "SELECT group_id, file_id, max(role) AS role FROM group_members GROUP BY 1, 2",
        "k05_new_groups": _NEW + " SELECT group_id id, tier || '_duplicates' reason, printf('confidence:%.3f|files:%d', any_value(confidence), count(*)) score_summary FROM tn GROUP BY group_id, tier",
        "k05_new_members": _NEW + " SELECT group_id, file_id, role, CASE role WHEN 'original' THEN 1.0::DOUBLE ELSE confidence END similarity_score FROM tn",
        "i03_rebuilt": _NEW + " SELECT 'old_groups' AS name, count(*) n FROM dup_groups UNION ALL SELECT 'old_members', count(*) FROM group_members UNION ALL SELECT 'new_groups', count(DISTINCT group_id) FROM tn UNION ALL SELECT 'new_members', count(*) FROM tn",
        "p05_lookup_by_path": f"{_C} SELECT id file_id, path, size FROM cur WHERE path IN (SELECT path FROM files)",
        "j18_exact_agreement": f"WITH {S.BASE}, {_MEM}, ex AS (SELECT min(file_id) OVER (PARTITION BY size, fast_hash, sha256) g, file_id, count(*) OVER (PARTITION BY size, fast_hash, sha256) n FROM rec WHERE fast_hash IS NOT NULL AND sha256 IS NOT NULL AND size IS NOT NULL), y AS (SELECT g, list_sort(list(file_id)) l FROM ex WHERE n >= 2 GROUP BY g), x AS (SELECT group_id, list_sort(list(file_id)) l FROM mem WHERE group_id IN (SELECT id FROM dup_groups WHERE reason = 'exact_duplicates') GROUP BY 1) SELECT (SELECT count(*) FROM x) expected, (SELECT count(*) FROM y) actual, (SELECT count(*) FROM x WHERE l IN (SELECT l FROM y)) same",
        "f26_health": f"{_C}, c AS (SELECT count(*) files, sum(length(path)) / 1048576.0 db, sum(size) FILTER (size > 0) / 1048576.0 cm FROM cur), i AS (SELECT files, (files = 0)::INT + coalesce(db / nullif(files, 0) > 0.1, false)::INT + (cm > 5000)::INT issues FROM c) SELECT files, issues, (['excellent', 'good', 'fair', 'poor'])[issues + 1] health FROM i",
        "a17_thumb_stats": f"{_C} SELECT status, count(*) FILTER (id IN (SELECT file_id FROM exif)) with_thumb, count(*) FILTER (id NOT IN (SELECT file_id FROM exif)) without_thumb FROM cur GROUP BY status",
        "a25_space_estimate": f"{_CM} SELECT group_id, coalesce(sum(size), 0)::BIGINT reclaimable FROM mem JOIN cur ON cur.id = mem.file_id WHERE role <> 'original' GROUP BY 1",
        "w06_last_deletions": dele + " SELECT method, batch_id, path, size FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY batch_id DESC, path) rn FROM de) WHERE rn <= 10",
        "i10_delete_plan": f"{_CM}, s AS (SELECT DISTINCT file_id FROM mem WHERE role = 'safe_duplicate'), r AS (SELECT CASE status WHEN 'active' THEN 'quarantine' ELSE 'skip' END AS method, size FROM s JOIN cur ON cur.id = s.file_id) SELECT method, count(*) files, coalesce(sum(size), 0)::BIGINT size, printf('%.1f MB', coalesce(sum(size), 0) / 1048576.0::DOUBLE) AS text FROM r GROUP BY 1",
        "t02_newest_files": f"{_C} SELECT id file_id, mtime FROM cur ORDER BY mtime DESC NULLS LAST, id LIMIT 10",
        "u06_selection_list": f"{_CM} SELECT file_id::VARCHAR chosen FROM mem JOIN cur ON cur.id = mem.file_id WHERE role = 'safe_duplicate' UNION ALL SELECT path FROM mem JOIN cur ON cur.id = mem.file_id WHERE role = 'duplicate'",
        "f34_batch_names": f"{_C} SELECT id file_id, 'batch_' || floor(last_seen_at)::BIGINT batch, 'deleted_' || strftime(make_timestamp(floor(last_seen_at)::BIGINT * 1000000), '%Y%m%d_%H%M%S') folder FROM cur",
        "t01_path_places": f"{_C} SELECT id file_id, row_number() OVER (ORDER BY path, id) place FROM cur",
    }
