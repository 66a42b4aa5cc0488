"""Queries on stored groups, choices by hand, snapshots and selections.

Tables that the data hasn't are read off the ones it has: a file's older states are the stored snapshot and its current
state the listing; a group's stored original is a choice by hand over the automatic one; promoted duplicates are selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import escalation, grouping, overrides, selection, snapshots
from lumatwin.plans import sqltext as S
from lumatwin.tables import current_features, current_files, table

NOW = 1_764_547_200.0  # 2025-12-01


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current files with the columns named, or all. Naming them keeps the scan narrow: the aggregate that picks the row hides unused ones from the optimizer."""
    names = ["id", "last_seen_at", *[c for c in columns if c != "last_seen_at"]] if columns else None
    found = current_files(spark, d, names).withColumnRenamed("id", "file_id")
    return found if not columns else found.select("file_id", *columns)


def members(spark: SparkSession, d: str) -> DataFrame:
    return escalation.once(table(spark, d, "group_members"))


def thumbs(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for thumbnails: the files with an exif row."""
    return table(spark, d, "exif").select("file_id").distinct()


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The first state known of each file: the snapshot before the current one."""
    rows = table(spark, d, "files").where("id IS NOT NULL")
    first = rows.groupBy("id").agg(F.min(F.struct("last_seen_at", "path", "size", "mtime", "status")).alias("s"))
    return first.select(F.col("id").alias("file_id"), "s.*")


def listing(spark: SparkSession, d: str) -> DataFrame:
    """What a scan finds: the current states of the files that aren't missing."""
    return files(spark, d, "path", "size", "mtime", "status").where("status <> 'missing'").select("path", "size", "mtime")


def automatic(spark: SparkSession, d: str) -> DataFrame:
    return grouping.originals(members(spark, d), files(spark, d, "path", "size", "dims_w", "dims_h", "exif_dt", "format"), "group_id")


def choices(spark: SparkSession, d: str) -> DataFrame:
    """Each stored original as a choice by hand over the automatic one; the smallest of several is the one in force."""
    auto = automatic(spark, d).withColumnRenamed("original_id", "auto_original_id")
    made = table(spark, d, "dup_groups").groupBy(F.col("id").alias("group_id")).agg(F.max("created_at").alias("created_at"), F.max("reason").alias("reason"))
    rows = members(spark, d).where("role = 'original'").select("group_id", F.col("file_id").alias("original_file_id")).join(auto, "group_id").join(made, "group_id")
    first = rows.groupBy("group_id").agg(F.min("original_file_id").alias("f"))
    rows = rows.join(first, "group_id").withColumn("is_active", F.col("original_file_id") == F.col("f")).drop("f")
    return rows.select(F.col("original_file_id").alias("override_id"), "group_id", "original_file_id", "auto_original_id", F.lit("single_group").alias("override_type"), "reason", "created_at", "is_active")


def escalated(spark, d):
    return escalation.escalate(members(spark, d), files(spark, d, "size", "exif_dt", "camera_model"))


def escalation_no_camera(spark, d):
    return escalation.escalate(members(spark, d), files(spark, d, "size", "exif_dt", "camera_model"), check_camera=False)


def escalation_summary(spark, d):
    return escalation.summarise(escalated(spark, d))


def escalation_applied(spark, d):
    return escalation.apply(members(spark, d), escalated(spark, d)).select("group_id", "file_id", "role", "notes")


def role_status(spark, d):
    return escalation.role_status(members(spark, d), table(spark, d, "dup_groups"))


def groups_with_files(spark, d):
    """Groups with their members and the active files of those."""
    g = table(spark, d, "dup_groups").select(F.col("id").alias("group_id"), "reason").distinct()
    return members(spark, d).join(g, "group_id").join(files(spark, d, "path", "status").where("status = 'active'").select("file_id", "path"), "file_id").select("group_id", "reason", "file_id", "role", "path")


def override_applied(spark, d):
    return overrides.apply(automatic(spark, d), members(spark, d), choices(spark, d))


def override_roles(spark, d):
    return overrides.set_roles(members(spark, d), override_applied(spark, d)).select("group_id", "file_id", "role")


def override_missing(spark, d):
    return overrides.missing_originals(choices(spark, d), files(spark, d, "status"))


def override_stats(spark, d):
    return overrides.stats(choices(spark, d))


def override_recorded(spark, d):
    """The automatic originals recorded over the stored ones; only files that are members can be chosen."""
    old = choices(spark, d)
    new = automatic(spark, d).select(
        (F.col("original_id") + 1_000_000_000).alias("override_id"), "group_id", F.col("original_id").alias("original_file_id"), F.col("original_id").alias("auto_original_id"), F.lit("single_group").alias("override_type"), F.lit("quality_better").alias("reason"), F.lit(NOW).alias("created_at")
    )
    return overrides.record(old, new, members(spark, d)).select("override_id", "group_id", "original_file_id", "is_active")


def override_removed(spark, d):
    """Choices of groups whose original isn't active any more are withdrawn."""
    return overrides.remove(choices(spark, d), override_missing(spark, d)).select("override_id", "group_id", "is_active")


def delta_diff(spark, d):
    return snapshots.diff(stored(spark, d), listing(spark, d))


def delta_work(spark, d):
    return snapshots.work(delta_diff(spark, d), table(spark, d, "features"), thumbs(spark, d))


def delta_stats(spark, d):
    return snapshots.stats(delta_work(spark, d), seconds=100)


def upsert_snapshot(spark, d):
    """The next snapshot. Files whose stored state is unknown to the listing are missing; paths never stored get new ids."""
    old = stored(spark, d)
    late = table(spark, d, "batch_items").where("batch_no = 6").select("file_id").distinct()  # brought by the last batch: not stored yet
    return snapshots.merge(old.join(late, "file_id", "left_anti"), listing(spark, d), NOW)


def mark_missing(spark, d):
    return snapshots.mark_missing(files(spark, d, "path", "status", "last_seen_at"), "/vault/ardent", 1_758_000_000.0).select("file_id", "path", "status")


def missing_features(spark, d):
    return snapshots.lacking(files(spark, d, "status"), table(spark, d, "features"))


def missing_work(spark, d):
    return snapshots.lacking(files(spark, d, "status"), table(spark, d, "features"), thumbs(spark, d))


def kept_features(spark, d):
    """Features that are still good after the changes."""
    f = current_features(spark, d, ["file_id", "feature_ver"])
    return snapshots.drop_of_changed(f, delta_diff(spark, d).where("file_id IS NOT NULL"))


def restore_members(spark, d):
    return snapshots.restorable(members(spark, d), choices(spark, d), files(spark, d, "status"))[0].select("group_id", "file_id")


def restore_overrides(spark, d):
    return snapshots.restorable(members(spark, d), choices(spark, d), files(spark, d, "status"))[1].select("group_id", "override_id")


def recommendation(spark, d):
    return snapshots.recommend(files(spark, d, "status"), table(spark, d, "features"), thumbs(spark, d))


def feature_coverage(spark, d):
    f = current_features(spark, d, ["file_id", "feature_ver", "fast_hash", "sha256", "phash", "dhash", "whash"])
    return snapshots.feature_coverage(f, ["fast_hash", "sha256", "phash", "dhash", "whash"])


def table_counts(spark, d):
    names = ["files", "features", "dup_groups", "group_members", "exif", "batch_items", "libraries"]
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def system_stats(spark, d):
    """One row of counts, MB of promoted duplicates, and the last time a file was seen."""
    m, f = members(spark, d), files(spark, d, "size", "last_seen_at")
    n = lambda r: F.count_if(F.col("role") == r)
    roles = m.join(f.select("file_id", "size"), "file_id", "left").agg(n("duplicate").alias("duplicates"), n("safe_duplicate").alias("safe_duplicates"), media.megabytes(F.coalesce(F.sum(F.when(F.col("role") == "safe_duplicate", F.col("size"))), F.lit(0))).alias("reclaimable_mb"))
    seen = f.agg(F.count("*").alias("files"), F.max("last_seen_at").alias("last_seen"))
    return roles.join(F.broadcast(seen))  # one row each


def selectable(spark: SparkSession, d: str) -> DataFrame:
    """Members with a file; promoted duplicates are selected."""
    rows = members(spark, d).join(files(spark, d, "path", "size"), "file_id")
    return rows.select("group_id", "file_id", "path", "size", "role", (F.col("role") == "safe_duplicate").alias("selected"))


def selection_duplicates(spark, d):
    """Duplicates selected too in the groups of near duplicates."""
    visible = table(spark, d, "dup_groups").where("reason = 'near_duplicates'").select(F.col("id").alias("group_id"))
    return selection.select_role(selectable(spark, d), ["duplicate"], visible).select("group_id", "file_id", "selected")


def selection_stats(spark, d):
    return selection.stats(selection.select_role(selectable(spark, d), ["duplicate"]))


def selection_state(spark, d):
    return selection.group_state(selectable(spark, d))


def view_safe(spark, d):
    """Groups of each view, counted."""
    flags = members(spark, d).groupBy("group_id").agg(F.bool_or(F.col("role") == "safe_duplicate").alias("has_safe"), (F.count_if(F.col("role") == "original") != 1).alias("has_conflict"))
    g = table(spark, d, "dup_groups").select(F.col("id").alias("group_id"), F.when(F.col("reason") == "exact_duplicates", "exact").otherwise("near").alias("tier")).distinct().join(flags, "group_id")
    parts = [selection.view(g, k).agg(F.count("*").alias("groups")).select(F.lit(k).alias("view"), "groups") for k in ("all", "exact", "near", "safe", "conflicts")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


def deleted(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in for the ledger of deletions: batches of files in the batches that brought them."""
    f = files(spark, d, "path", "size", "status")
    method = F.when(F.col("status") == "deleted", "permanent").when(F.col("status") == "missing", "recycle").otherwise("quarantine")
    b = table(spark, d, "batch_items").where("file_id IS NOT NULL").groupBy("file_id").agg(F.min("batch_no").alias("batch_id"))
    return b.join(f, "file_id").select("batch_id", "path", "size", method.alias("method"))


def delete_batches(spark, d):
    return selection.batches(deleted(spark, d))


def undo_last(spark, d):
    return selection.undo_last(deleted(spark, d)).select("batch_id", "path", "restorable")


def quarantine_names(spark, d):
    return selection.quarantine_names(table(spark, d, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("album_key", F.lit("x")), F.lit(".txt")).alias("path")).distinct())


def queries() -> dict:
    return {
        "j12_escalation_criteria": escalated, "p12_escalation_no_camera": escalation_no_camera, "a07_escalation_summary": escalation_summary, "k10_escalation_applied": escalation_applied, "a06_role_status": role_status, "j05_groups_with_files": groups_with_files,
        "j21_override_apply": override_applied, "k11_override_roles": override_roles, "i07_override_missing": override_missing, "a11_override_stats": override_stats, "k12_override_recorded": override_recorded, "k13_override_removed": override_removed,
        "j14_delta_diff": delta_diff, "i01_delta_work": delta_work, "a19_delta_stats": delta_stats, "k02_upsert_snapshot": upsert_snapshot, "k06_mark_missing": mark_missing, "j03_missing_features": missing_features, "u03_missing_work": missing_work,
        "k08_kept_features": kept_features, "j13_restore_members": restore_members, "j13_restore_overrides": restore_overrides, "a20_recommendation": recommendation, "a09_feature_coverage": feature_coverage, "a08_table_counts": table_counts, "a13_system_stats": system_stats,
        "p17_selection_duplicates": selection_duplicates, "a12_selection_stats": selection_stats, "a26_selection_state": selection_state, "p15_views": view_safe, "a28_delete_batches": delete_batches, "w12_undo_last": undo_last, "f33_quarantine_names": quarantine_names,
    }


_MEM = "mem AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY group_id, file_id ORDER BY CASE role WHEN 'original' THEN 0 WHEN 'safe_duplicate' THEN 1 ELSE 2 END, similarity_score NULLS FIRST, notes NULLS FIRST) rn FROM group_members) WHERE rn = 1)"
_BASE = f"WITH {S.CURRENT}, {_MEM}"
_DT = "CASE WHEN {0}.exif_dt <> 0 AND NOT isnan({0}.exif_dt) THEN {0}.exif_dt END"


def _escalated(camera: bool) -> str:
    both = f"{_DT.format('o')} IS NULL AND {_DT.format('u')} IS NULL"
    cam = "lower(trim(coalesce(o.camera_model, ''))) = lower(trim(coalesce(u.camera_model, '')))" if camera else "true"
    return f"""{_BASE}, fo AS (SELECT group_id, min(file_id) original_id FROM mem WHERE role = 'original' GROUP BY 1),
c AS (SELECT m.group_id, m.file_id, original_id, coalesce(o.size = u.size AND o.size > 0, false) size_match, CASE WHEN {both} THEN {str(not camera).lower()} ELSE coalesce(abs({_DT.format("o")} - {_DT.format("u")}) <= 2, false) END datetime_match, {cam} camera_match
  FROM mem m JOIN fo USING (group_id) JOIN cur o ON o.id = original_id JOIN cur u ON u.id = m.file_id WHERE m.role = 'duplicate'),
es AS (SELECT *, CASE WHEN NOT (size_match OR datetime_match OR camera_match) THEN 'no_match' ELSE concat_ws(' + ', CASE WHEN size_match THEN 'file_size' END, CASE WHEN datetime_match THEN 'datetime' END, CASE WHEN camera_match THEN 'camera_model' END) END criteria,
  CASE WHEN size_match AND datetime_match AND camera_match THEN 'safe_duplicate' ELSE 'duplicate' END new_role FROM c)"""


_AUTO = f"""{_BASE}, au AS (SELECT group_id, file_id original_id FROM (SELECT m.group_id, m.file_id, row_number() OVER (PARTITION BY m.group_id ORDER BY {S.ORDER.replace("file_id", "m.file_id")}) rn FROM mem m JOIN cur ON cur.id = m.file_id) WHERE rn = 1),
ch AS (SELECT m.file_id override_id, m.group_id, m.file_id original_file_id, au.original_id auto_original_id, g.reason, g.created_at, m.file_id = min(m.file_id) OVER (PARTITION BY m.group_id) is_active
  FROM mem m JOIN au USING (group_id) JOIN (SELECT id, max(reason) reason, max(created_at) created_at FROM dup_groups GROUP BY 1) g ON g.id = m.group_id WHERE m.role = 'original'),
ap AS (SELECT au.group_id, coalesce(ch.original_file_id, au.original_id) original_id, ch.group_id IS NOT NULL by_hand, CASE WHEN ch.original_file_id <> au.original_id THEN 'differs' ELSE 'none' END conflict FROM au LEFT JOIN ch ON ch.group_id = au.group_id AND ch.is_active),
gone AS (SELECT ch.* FROM ch WHERE is_active AND original_file_id NOT IN (SELECT id FROM cur WHERE status = 'active'))"""
_STATES = f"""WITH {S.CURRENT}, st AS (SELECT id file_id, path, size, mtime, status, last_seen_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_seen_at) rn FROM files) WHERE rn = 1),
li AS (SELECT path, size, mtime FROM cur WHERE status <> 'missing')"""
_DIFFERS = "({0}.size IS DISTINCT FROM li.size OR coalesce(abs({0}.mtime - li.mtime) >= 1, ({0}.mtime IS NULL) <> (li.mtime IS NULL)))"
_DELTA = f"""{_STATES}, df AS (SELECT coalesce(st.path, li.path) path, file_id, CASE WHEN st.path IS NULL THEN 'new' WHEN li.path IS NULL THEN 'missing' WHEN {_DIFFERS.format("st")} THEN 'changed' ELSE 'unchanged' END change FROM st FULL JOIN li ON st.path = li.path)"""
_MERGED = f"""{_STATES}, o AS (SELECT * FROM st WHERE file_id NOT IN (SELECT file_id FROM batch_items WHERE batch_no = 6 AND file_id IS NOT NULL)),
j AS (SELECT coalesce(o.path, li.path) path, o.file_id, li.path IS NULL gone, {_DIFFERS.format("o")} differs, o.size osz, li.size nsz, o.mtime omt, li.mtime nmt, o.status, o.last_seen_at FROM o FULL JOIN li ON o.path = li.path)
SELECT path, coalesce(file_id, (SELECT max(file_id) FROM o) + row_number() OVER (PARTITION BY file_id IS NULL ORDER BY path)) file_id, CASE WHEN gone THEN osz ELSE nsz END size, CASE WHEN gone THEN omt ELSE nmt END mtime,
  CASE WHEN gone AND status = 'active' THEN 'missing' WHEN gone OR (file_id IS NOT NULL AND NOT differs) THEN status ELSE 'active' END status, CASE WHEN gone THEN last_seen_at ELSE {NOW} END last_seen_at FROM j"""
_WORK = _DELTA + """, wk AS (SELECT path, file_id, change, change <> 'missing' AND (change IN ('new', 'changed') OR file_id IS NULL OR file_id NOT IN (SELECT file_id FROM features)) needs_features,
  change <> 'missing' AND (change IN ('new', 'changed') OR file_id IS NULL OR file_id NOT IN (SELECT file_id FROM exif)) needs_thumbnail FROM df)"""
_SEL = f"{_BASE}, se AS (SELECT m.group_id, m.file_id, path, size, role, role = 'safe_duplicate' selected FROM mem m JOIN cur ON cur.id = m.file_id)"
_DEL = f"""WITH {S.CURRENT}, de AS (SELECT batch_id, path, size, CASE status WHEN 'deleted' THEN 'permanent' WHEN 'missing' THEN 'recycle' ELSE 'quarantine' END AS method FROM (SELECT file_id, min(batch_no) batch_id FROM batch_items GROUP BY 1) b JOIN cur ON cur.id = b.file_id)"""


def oracle_sql() -> dict[str, str]:
    cols = "group_id, file_id, original_id, size_match, datetime_match, camera_match, criteria, new_role"
    flags = {"all_criteria": (1, 1, 1), "size_and_datetime": (1, 1, 0), "size_and_camera": (1, 0, 1), "datetime_and_camera": (0, 1, 1), "size_match_only": (1, 0, 0), "datetime_match_only": (0, 1, 0), "camera_match_only": (0, 0, 1), "no_criteria": (0, 0, 0)}
    counted = ", ".join(f"count(*) FILTER (size_match = {bool(a)} AND datetime_match = {bool(b)} AND camera_match = {bool(c)}) {n}" for n, (a, b, c) in flags.items())
    live = "(SELECT id FROM cur WHERE status = 'active')"
    views = {"all": "true", "exact": "tier = 'exact'", "near": "tier = 'near'", "safe": "s", "conflicts": "k"}
    return {
        "j12_escalation_criteria": _escalated(True) + f" SELECT {cols} FROM es",
        "p12_escalation_no_camera": _escalated(False) + f" SELECT {cols} FROM es",
        "a07_escalation_summary": _escalated(True) + f" SELECT count(*) total_analyzed, count(*) FILTER (new_role = 'safe_duplicate') safe_duplicates_found, coalesce(count(*) FILTER (new_role = 'safe_duplicate') / count(*), 0) escalation_rate, {counted}, count(DISTINCT group_id) FILTER (new_role = 'safe_duplicate') groups_affected FROM es",
        "k10_escalation_applied": _escalated(True) + " SELECT m.group_id, m.file_id, coalesce(CASE WHEN e.new_role = 'safe_duplicate' THEN e.new_role END, m.role) AS role, CASE WHEN e.new_role = 'safe_duplicate' THEN 'escalated: ' || criteria ELSE m.notes END notes FROM mem m LEFT JOIN es e USING (group_id, file_id)",
        "a06_role_status": f"{_BASE} SELECT count(*) FILTER (role = 'original') original, count(*) FILTER (role = 'duplicate') AS duplicate, count(*) FILTER (role = 'safe_duplicate') safe_duplicate, count(*) FILTER (role = 'safe_duplicate') * 100.0::DOUBLE / greatest(1, count(*) FILTER (role IN ('duplicate', 'safe_duplicate'))) safe_percentage, count(DISTINCT group_id) FILTER (role = 'safe_duplicate' AND group_id IN (SELECT id FROM dup_groups)) groups_with_safe, (SELECT count(DISTINCT id) FROM dup_groups) total_groups FROM mem",
        "j05_groups_with_files": f"{_BASE} SELECT m.group_id, g.reason, m.file_id, m.role, path FROM mem m JOIN (SELECT DISTINCT id, reason FROM dup_groups) g ON g.id = m.group_id JOIN cur ON cur.id = m.file_id WHERE status = 'active'",
        "j21_override_apply": _AUTO + " SELECT * FROM ap",
        "k11_override_roles": _AUTO + " SELECT m.group_id, m.file_id, CASE WHEN ap.group_id IS NULL THEN m.role WHEN m.file_id = ap.original_id THEN 'original' ELSE 'duplicate' END AS role FROM mem m LEFT JOIN ap USING (group_id)",
        "i07_override_missing": _AUTO + " SELECT group_id, original_file_id, auto_original_id, 0.0::DOUBLE confidence, 'accept_auto,choose_new,remove_override' actions FROM gone",
        "a11_override_stats": _AUTO + " SELECT 'total' what, 'all' AS name, count(*) n, 100.0::DOUBLE percent FROM ch UNION ALL SELECT 'total', 'active', count(*) FILTER (is_active), count(*) FILTER (is_active) * 100.0::DOUBLE / greatest(1, count(*)) FROM ch UNION ALL SELECT 'type', 'single_group', count(*), NULL FROM ch WHERE is_active UNION ALL SELECT 'reason', reason, count(*), NULL FROM ch WHERE is_active GROUP BY reason",
        "k12_override_recorded": _AUTO + " SELECT override_id, group_id, original_file_id, false is_active FROM ch UNION ALL SELECT original_id + 1000000000, group_id, original_id, true FROM au",
        "k13_override_removed": _AUTO + " SELECT override_id, group_id, is_active AND group_id NOT IN (SELECT group_id FROM gone) is_active FROM ch",
        "j14_delta_diff": _DELTA + " SELECT * FROM df",
        "i01_delta_work": _WORK + " SELECT * FROM wk",
        "a19_delta_stats": _WORK + " SELECT count(*) FILTER (change = 'new') files_new, count(*) FILTER (change = 'changed') files_changed, count(*) FILTER (change = 'unchanged') files_unchanged, count(*) FILTER (change = 'missing') files_missing, count(*) FILTER (change <> 'missing') files_total, count(*) FILTER (needs_features OR needs_thumbnail) files_processed, count(*) FILTER (needs_features OR needs_thumbnail) / 100.0::DOUBLE files_per_second, count(*) FILTER (change = 'unchanged') / count(*) FILTER (change <> 'missing') reuse_ratio FROM wk",
        "k02_upsert_snapshot": _MERGED,
        "k06_mark_missing": f"WITH {S.CURRENT} SELECT id file_id, path, CASE WHEN starts_with(path, '/vault/ardent/') AND last_seen_at < 1758000000 AND status = 'active' THEN 'missing' ELSE status END status FROM cur",
        "j03_missing_features": f"WITH {S.CURRENT} SELECT id file_id FROM cur WHERE status = 'active' AND id NOT IN (SELECT file_id FROM features)",
        "u03_missing_work": f"WITH {S.CURRENT} SELECT id file_id FROM cur WHERE status = 'active' AND (id NOT IN (SELECT file_id FROM features) OR id NOT IN (SELECT file_id FROM exif))",
        "k08_kept_features": _DELTA + " SELECT file_id, max(feature_ver) feature_ver FROM features WHERE file_id NOT IN (SELECT file_id FROM df WHERE change = 'changed') GROUP BY 1",
        "j13_restore_members": f"{_BASE} SELECT group_id, file_id FROM mem WHERE file_id IN {live}",
        "j13_restore_overrides": _AUTO + f" SELECT group_id, override_id FROM ch WHERE original_file_id <> auto_original_id AND original_file_id IN {live} AND auto_original_id IN {live}",
        "a20_recommendation": f"WITH {S.CURRENT}, c AS (SELECT count(*) total_files, count(*) FILTER (id NOT IN (SELECT file_id FROM features)) missing_features, count(*) FILTER (id NOT IN (SELECT file_id FROM exif)) missing_thumbs FROM cur WHERE status = 'active') SELECT *, CASE WHEN missing_features > total_files * 0.5 OR missing_thumbs > total_files * 0.5 THEN 'full_rebuild' WHEN missing_features > 0 OR missing_thumbs > 0 THEN 'missing_features' ELSE 'delta_only' END recommended FROM c",
        "a09_feature_coverage": "SELECT count(*) total, count(fast_hash) fast_hash, count(sha256) sha256, count(phash) phash, count(dhash) dhash, count(whash) whash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1",
        "a08_table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) n FROM {n}" for n in ["files", "features", "dup_groups", "group_members", "exif", "batch_items", "libraries"]),
        "a13_system_stats": f"{_BASE} SELECT count(*) FILTER (role = 'duplicate') duplicates, count(*) FILTER (role = 'safe_duplicate') safe_duplicates, coalesce(sum(size) FILTER (role = 'safe_duplicate'), 0) / 1048576.0::DOUBLE reclaimable_mb, (SELECT count(*) FROM cur) files, (SELECT max(last_seen_at) FROM cur) last_seen FROM mem LEFT JOIN cur ON cur.id = mem.file_id",
        "p17_selection_duplicates": _SEL + " SELECT group_id, file_id, selected OR (role = 'duplicate' AND group_id IN (SELECT id FROM dup_groups WHERE reason = 'near_duplicates')) selected FROM se",
        "a12_selection_stats": _SEL + " SELECT count(*) total_selected, count(*) FILTER (role = 'safe_duplicate') safe_selected, count(*) FILTER (role = 'duplicate') duplicate_selected, count(DISTINCT group_id) groups_affected, coalesce(sum(size), 0)::BIGINT total_size, coalesce(sum(size) FILTER (role = 'duplicate'), 0)::BIGINT reclaimable_size FROM se WHERE role IN ('duplicate', 'safe_duplicate')",
        "a26_selection_state": _SEL + " SELECT group_id, CASE WHEN bool_and(selected) THEN 'all' WHEN bool_or(selected) THEN 'partial' ELSE 'none' END state FROM se GROUP BY 1",
        "p15_views": f"{_BASE}, fl AS (SELECT group_id, bool_or(role = 'safe_duplicate') s, count(*) FILTER (role = 'original') <> 1 k FROM mem GROUP BY 1), g AS (SELECT DISTINCT d.id, CASE WHEN reason = 'exact_duplicates' THEN 'exact' ELSE 'near' END tier, s, k FROM dup_groups d JOIN fl ON fl.group_id = d.id) " + " UNION ALL ".join(f"SELECT '{v}' AS \"view\", count(*) FILTER ({w}) \"groups\" FROM g" for v, w in views.items()),
        "a28_delete_batches": _DEL + " SELECT batch_id, count(*) files, sum(size)::BIGINT size, sum(size) / 1048576.0::DOUBLE megabytes FROM de GROUP BY 1",
        "w12_undo_last": _DEL + " SELECT batch_id, path, method = 'quarantine' restorable FROM de WHERE batch_id = (SELECT max(batch_id) FROM de)",
        "f33_quarantine_names": r"""WITH p AS (SELECT DISTINCT '/' || source || '/' || coalesce(lang, 'none') || '/' || coalesce(album_key, 'x') || '.txt' path FROM documents), k AS (SELECT path, regexp_extract(path, '[^/]*$') nm, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY path) - 1 k FROM p)
SELECT path, CASE WHEN k = 0 THEN nm ELSE regexp_replace(nm, '\.[^.]*$', '') || '_' || k || regexp_extract(nm, '\.[^.]*$') END stored_as FROM k""",
    }
