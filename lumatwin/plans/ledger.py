"""Queries on cache entries, thumbnails, deletions, exports, presets and merged exif rows.

Files stand for what the data hasn't: those of batch 6 are used, those of batch 5 come anew, active ones are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import caches, ordered, overrides, presets, selection, signatures
from lumatwin.plans import sqltext as S
from lumatwin.plans.fields import exif_rows, report
from lumatwin.plans.upkeep import NOW, cache_files, entries
from lumatwin.plans.workflow import _AUTO, _BASE, _DEL, _SEL, choices, deleted, files, members, override_missing, selectable
from lumatwin.sources import images
from lumatwin.tables import table

CAP = 4_000_000_000.0


def brought(spark: SparkSession, d: str, batch: int) -> DataFrame:
    return table(spark, d, "batch_items").where(F.col("batch_no") == batch).select("file_id").distinct()


def keyed_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d, "path_hash", "path", "size", "status").withColumnRenamed("path_hash", "key")


def cache_after_work(spark, d):
    """The entries after those of one batch were added, those of another used, and those of files that are gone removed."""
    f = keyed_files(spark, d)
    new = f.join(brought(spark, d, 5), "file_id", "left_semi").select("key", "path", F.greatest("size", F.lit(0)).alias("size"), F.lit("thumbnail").alias("entry_type"))
    rows = caches.add(entries(spark, d), new, NOW)
    rows = caches.touch(rows, f.join(brought(spark, d, 6), "file_id", "left_semi"), NOW + 60)
    return caches.remove(rows, f.where("status = 'deleted'")).select("key", "size", "created_at", "last_accessed", F.coalesce("entry_type", F.lit("")).alias("entry_type"))


def cache_cleared(spark, d):
    return caches.clear(entries(spark, d))[1].withColumn("cleared_size_mb", F.round("cleared_size_mb", 6))


def cache_figures(spark, d):
    row = caches.figures(cache_files(spark, d), NOW)
    return row.withColumns({c: F.round(c, 6) for c in ("total_size_mb", "reclaimable_size_mb", "fragmentation_level")})


def thumb_rows(spark, d):
    """The rows of thumbnails after the files of batches 5 and 6 were asked for. Every third file had one; those of active files are still there."""
    f = files(spark, d, "path", "size", "mtime", "dims_w", "dims_h", "status", "created_at")
    w, h = media.thumb_size(F.col("dims_w"), F.col("dims_h"), 256)
    rows = f.where(media.extension(F.col("path")).isin(media.THUMB_FORMATS)).select("file_id", media.thumb_name(F.col("path"), F.col("size"), F.col("mtime")).alias("thumb_path"), w.alias("thumb_w"), h.alias("thumb_h"), "created_at", F.col("created_at").alias("last_used_at"), "status").where("thumb_w IS NOT NULL")
    old = rows.where("file_id % 3 = 0")
    asked = brought(spark, d, 5).union(brought(spark, d, 6))
    return caches.thumbs_asked(old.drop("status"), asked, old.where("status = 'active'").select("thumb_path"), rows.drop("status"), NOW)


def cleanup_runs(spark, d):
    """Files and bytes that a cleanup takes after each trigger."""
    f = cache_files(spark, d)
    out = None
    for t in caches.TRIGGERS:
        part = caches.cleanup(f, t, NOW, CAP).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).select(F.lit(t).alias("trigger"), F.lit(caches.TRIGGERS[t]).alias("mode"), "files", "size")
        out = part if out is None else out.union(part)
    return out


def selection_export(spark, d):
    """The exported rows of a selection of all duplicates."""
    return selection.exported(selection.select_role(selectable(spark, d), ["duplicate"]))


def role_labels(spark, d):
    role = F.col("role")
    return members(spark, d).select("group_id", "file_id", selection.role_label(role == "original", role == "safe_duplicate").alias("label"))


def export_document(spark, d):
    """The records of a report as JSON objects of texts, and its metadata as one more."""
    rows = report(spark, d)
    stamp = F.date_format(F.timestamp_micros((F.col("action_timestamp") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("action_timestamp_formatted")
    names = ["original_path", "duplicate_path", "tag", "reason", "file_hash", "perceptual_hash", "exif_differences", "camera_make", "camera_model", "date_taken", "resolution", "action_taken", "created_date", "modified_date"]
    body = F.to_json(F.struct(F.col("group_id").cast("string").alias("group_id"), *names, F.col("file_size").cast("string").alias("file_size"), F.col("original_size").cast("string").alias("original_size"), stamp), {"ignoreNullFields": "false"})
    head = rows.agg(F.count("*").alias("total_records")).select(F.lit("metadata").alias("kind"), F.to_json(F.struct("total_records")).alias("body"))
    return rows.select(F.lit("record").alias("kind"), body.alias("body")).union(head)


def report_figures(spark, d):
    """The numbers of all report rows."""
    return report(spark, d).select("group_id", "duplicate_path", *[F.round(c, 6).alias(c) for c in ("quality_score", "compression_ratio", "confidence_level")], "file_hash", "perceptual_hash", "camera_model", "modified_date")


def undo_totals(spark, d):
    return selection.undo_totals(deleted(spark, d))


def ledger_status(spark, d):
    """The states of all files after the promoted duplicates were deleted as one batch, with the bytes of each state."""
    f = files(spark, d, "path", "size", "status")
    batch, after = selection.ledger(f, members(spark, d).where("role = 'safe_duplicate'"), "quarantine", 7)
    sums = lambda df, n: df.groupBy(F.col(n).alias("state")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return sums(after, "status").union(sums(batch, "method"))


def override_restored(spark, d):
    """Roles after the choices whose file isn't active were withdrawn: the automatic original is the original again."""
    gone = override_missing(spark, d).select("group_id", F.col("auto_original_id").alias("original_id"))
    return overrides.set_roles(members(spark, d), gone).select("group_id", "file_id", "role")


def override_order(spark, d):
    """Choices, the newest first."""
    return ordered.running(choices(spark, d).select("override_id", "group_id", "created_at"), [-F.col("created_at"), F.col("override_id"), F.col("group_id")]).drop("before")


def latest_version(spark, d):
    """The highest version of features there is."""
    return table(spark, d, "features").select("feature_ver").where("feature_ver IS NOT NULL").orderBy(F.desc("feature_ver")).limit(1)


def preset_names(spark, d):
    """The settings of each library, made of a preset by its id, with one changed in every fourth; and the radius of the preset."""
    names, k = list(presets.PRESETS), F.pmod("library_id", F.lit(3))
    of = lambda key: F.element_at(F.array(*[F.lit(presets.PRESETS[n][key]) for n in names]), k.cast("int") + 1)
    rows = table(spark, d, "libraries").where("library_id IS NOT NULL").select("library_id", *[of(key).alias(key) for key in presets.PRESETS["Balanced"]])
    rows = rows.withColumn("thread_cap", F.when(F.col("library_id") % 4 == 0, 3).otherwise(F.col("thread_cap")))
    name = presets.preset_name({key: F.col(key) for key in presets.PRESETS["Balanced"]})
    radius = F.coalesce(*[F.when(F.col("preset") == n, F.lit(r)) for n, r in presets.RADIUS.items()])
    return rows.select("library_id", name.alias("preset")).withColumn("radius", radius)


def exif_merged(spark, d):
    """Exif rows as read first, files' own columns as the second reader."""
    first = exif_rows(spark, d).select("file_id", "orientation", "camera_make", "camera_model", "camera_full")
    second = files(spark, d, "orientation", "camera_model").select("file_id", "orientation", F.lit(None).cast("string").alias("camera_make"), "camera_model", F.col("camera_model").alias("camera_full"))
    return images.merged_exif(first, second)


def signature_rows(spark, d):
    """Signatures of the embeddings of each label, spread over bytes."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL").select("label", F.transform("embedding", lambda v: (v.cast("double") + 1.0) * 127.5).alias("v"))
    return signatures.moments(e, "label", "v")


def queries() -> dict:
    return {
        "k22_cache_entries": cache_after_work, "k22_cache_cleared": cache_cleared, "k23_cache_figures": cache_figures, "k21_thumb_rows": thumb_rows, "i05_cleanup_runs": cleanup_runs, "k19_selection_export": selection_export, "f23_role_labels": role_labels,
        "k17_export_document": export_document, "j19_report_figures": report_figures, "w12_undo_totals": undo_totals, "i09_ledger": ledger_status, "k13_override_restored": override_restored, "t05_override_order": override_order, "t06_latest_version": latest_version,
        "f27_preset_names": preset_names, "s08_exif_merged": exif_merged, "a27_signatures": signature_rows,
    }


def oracle_sql() -> dict[str, str]:
    from lumatwin.plans.fields import _EX, _REP, _DAY
    from lumatwin.plans.upkeep import _ENT, _FIL, _REC, _TEMP, _BROKEN

    batch = lambda k: f"(SELECT file_id FROM batch_items WHERE batch_no = {k} AND file_id IS NOT NULL)"
    sums = lambda t, m, w, x="cf": f"SELECT '{t}' AS \"trigger\", '{m}' AS \"mode\", count(*) files, coalesce(sum(size), 0)::BIGINT size FROM {x} WHERE {w}"
    full = f"(age > 30 OR size = 0 OR {_BROKEN} OR ({_TEMP} AND age > 1))"
    texts = ["original_path", "duplicate_path", "tag", "reason", "file_hash", "perceptual_hash", "exif_differences", "camera_make", "camera_model", "date_taken", "resolution", "action_taken", "created_date", "modified_date", "file_size", "original_size"]
    more = f""", rx AS (SELECT rp.*, u.camera_model, ft.sha256 file_hash, ft.phash perceptual_hash, concat_ws(', ', CASE WHEN NOT st THEN 'time' END, CASE WHEN NOT sc THEN 'camera' END) exif_differences,
  {_DAY.format("rp.exif_dt")} date_taken, rp.dims_w || 'x' || rp.dims_h resolution, 'none' action_taken, {_DAY.format("rp.created_at")} created_date, {_DAY.format("u.mtime")} modified_date, m.similarity_score quality
  FROM rp JOIN cur u ON u.path = rp.duplicate_path JOIN mem m ON m.group_id = rp.group_id AND m.file_id = u.id LEFT JOIN ft ON ft.file_id = u.id)"""
    names = list(presets.PRESETS)
    thumb = "'thumb_' || left(sha256(concat_ws(':', path, size::VARCHAR, floor(coalesce(mtime, 0))::BIGINT::VARCHAR)), 16) || '.webp'"
    exts = "(" + ", ".join(f"'{x}'" for x in media.THUMB_FORMATS) + ")"
    return {
        "k22_cache_entries": _ENT + f""", f AS (SELECT id, path_hash AS key, path, greatest(size, 0) size, status FROM cur), nw AS (SELECT key, max(path) path, max_by(size, path) size FROM f WHERE id IN {batch(5)} AND key IS NOT NULL GROUP BY key),
a AS (SELECT key, size, created_at, last_accessed, entry_type FROM en WHERE key IS NULL OR key NOT IN (SELECT key FROM nw) UNION ALL SELECT key, size, {NOW}::DOUBLE, {NOW}::DOUBLE, 'thumbnail' FROM nw)
SELECT key, size, created_at, CASE WHEN key IN (SELECT key FROM f WHERE id IN {batch(6)}) THEN {NOW + 60}::DOUBLE ELSE last_accessed END last_accessed, coalesce(entry_type, '') entry_type FROM a WHERE key IS NULL OR key NOT IN (SELECT key FROM f WHERE status = 'deleted' AND key IS NOT NULL)""",
        "k22_cache_cleared": _ENT + " SELECT count(*) cleared_entries, round(coalesce(sum(size), 0) / 1048576.0::DOUBLE, 6) cleared_size_mb FROM en",
        "k23_cache_figures": _REC + """, t AS (SELECT count(*) n, sum(size) s, min(mtime) o, max(mtime) w, CASE WHEN count(*) < 10 THEN 0 ELSE (least(var_pop(age) / 100, 1) + least(var_pop(size) / 1048576, 1)) / 2 END fr FROM cf)
SELECT n total_files, round(coalesce(s, 0) / 1048576.0::DOUBLE, 6) total_size_mb, (SELECT round(coalesce(sum(size), 0) / 1048576.0::DOUBLE, 6) FROM go) reclaimable_size_mb, strftime(make_timestamp(floor(o)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') oldest_file_date, strftime(make_timestamp(floor(w)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') newest_file_date, round(fr, 6) fragmentation_level FROM t""",
        "k21_thumb_rows": f"""WITH {S.CURRENT}, r AS (SELECT id file_id, {thumb} thumb_path, CASE WHEN dims_w >= dims_h THEN 256 ELSE greatest(1, floor(dims_w * (256.0::DOUBLE / dims_h)))::INT END thumb_w, CASE WHEN dims_w >= dims_h THEN greatest(1, floor(dims_h * (256.0::DOUBLE / dims_w)))::INT ELSE 256 END thumb_h, created_at, status,
  id IN {batch(5)} OR id IN {batch(6)} asked FROM cur WHERE {S.EXTENSION} IN {exts} AND dims_w > 0 AND dims_h > 0)
SELECT file_id, thumb_path, thumb_w, thumb_h, CASE WHEN file_id % 3 = 0 AND (status = 'active' OR NOT asked) THEN created_at ELSE {NOW} END created_at, CASE WHEN asked THEN {NOW} ELSE created_at END last_used_at FROM r WHERE asked OR file_id % 3 = 0""",
        "i05_cleanup_runs": _FIL + f""", r AS (SELECT size, coalesce(sum(size) OVER (ORDER BY age DESC, size DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, sum(size) OVER () t FROM cf)
{sums("app_start", "fast_sweep", "age > 7")} UNION ALL {sums("periodic_idle", "full_sweep", full)} UNION ALL {sums("manual", "full_sweep", full)} UNION ALL {sums("size_cap_breach", "size_purge", f"t > {CAP} AND b < t - {CAP * 0.8}", "r")}""",
        "k19_selection_export": _SEL + " SELECT file_id, group_id, path file_path, size file_size, role, true is_selected, role = 'safe_duplicate' is_safe_duplicate FROM se WHERE role IN ('duplicate', 'safe_duplicate')",
        "f23_role_labels": f"{_BASE} SELECT group_id, file_id, CASE role WHEN 'original' THEN 'original' WHEN 'safe_duplicate' THEN 'safe_duplicate' ELSE 'duplicate' END AS label FROM mem",
        "k17_export_document": _REP + more + f""" SELECT 'metadata' kind, '{{"total_records":' || count(*) || '}}' body FROM rp UNION ALL SELECT 'record', json_object('group_id', group_id::VARCHAR, {", ".join(f"'{n}', {n}::VARCHAR" for n in texts)}, 'action_timestamp_formatted', NULL)::VARCHAR FROM rx""",
        "j19_report_figures": _REP + more + " SELECT group_id, duplicate_path, round(quality, 6) quality_score, CASE WHEN dims_w <> 0 AND dims_h <> 0 THEN round(file_size::DOUBLE / (dims_w::BIGINT * dims_h), 6) END compression_ratio, round(quality, 6) confidence_level, file_hash, perceptual_hash, camera_model, modified_date FROM rx",
        "w12_undo_totals": _DEL + ", l AS (SELECT *, batch_id = (SELECT max(batch_id) FROM de) AND method = 'quarantine' back FROM de), s AS (SELECT count(*) files, sum(size)::BIGINT size, count(*) FILTER (back) restored, coalesce(sum(size) FILTER (back), 0)::BIGINT restored_size FROM l) SELECT *, files - restored files_left, size - restored_size size_left FROM s",
        "i09_ledger": f"{_BASE}, g AS (SELECT cur.*, id IN (SELECT file_id FROM mem WHERE role = 'safe_duplicate') AND coalesce(status = 'active', false) gone FROM cur) SELECT CASE WHEN gone THEN 'deleted' ELSE status END state, count(*) files, coalesce(sum(size), 0)::BIGINT size FROM g GROUP BY 1 UNION ALL SELECT 'quarantine', count(*), coalesce(sum(size), 0)::BIGINT FROM g WHERE gone HAVING count(*) > 0",
        "k13_override_restored": _AUTO + " SELECT m.group_id, m.file_id, CASE WHEN gone.group_id IS NULL THEN m.role WHEN m.file_id = gone.auto_original_id THEN 'original' ELSE 'duplicate' END AS role FROM mem m LEFT JOIN gone USING (group_id)",
        "t05_override_order": _AUTO + " SELECT override_id, group_id, created_at, row_number() OVER (ORDER BY created_at DESC, override_id, group_id) place FROM ch",
        "t06_latest_version": "SELECT max(feature_ver) feature_ver FROM features HAVING max(feature_ver) IS NOT NULL",
        "f27_preset_names": f"""SELECT library_id, CASE WHEN library_id % 4 = 0 THEN 'Custom' ELSE ({names})[library_id % 3 + 1] END preset, CASE WHEN library_id % 4 <> 0 THEN ([6, 8, 12])[library_id % 3 + 1] END radius FROM libraries""",
        "s08_exif_merged": _EX.replace("WITH ex", f"WITH {S.CURRENT}, ex", 1) + """, j AS (SELECT ex.file_id, coalesce(CASE WHEN f BETWEEN 1 AND 8 THEN f END, 1) o, cur.orientation o2, ex.camera_make mk, ex.camera_model md, ex.e fu, cur.camera_model m2 FROM ex LEFT JOIN cur ON cur.id = ex.file_id),
k AS (SELECT *, o = 1 AND coalesce(fu, '') = '' AND coalesce(m2, '') <> '' fill FROM j)
SELECT file_id, CASE WHEN o = 1 AND o2 BETWEEN 2 AND 8 THEN o2 ELSE o END orientation, CASE WHEN fill THEN NULL ELSE mk END camera_make, CASE WHEN fill THEN m2 ELSE md END camera_model, CASE WHEN fill THEN m2 ELSE fu END camera_full FROM k""",
        "a27_signatures": """WITH v AS (SELECT label, generate_subscripts(embedding, 1) i, (unnest(embedding)::DOUBLE + 1) * 127.5 x FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, greatest(0, least(255, floor(avg(x))))::INT a, greatest(0, least(255, floor(stddev_pop(x))))::INT s FROM v WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT label, string_agg(printf('%02x', a), '' ORDER BY i) || string_agg(printf('%02x', s), '' ORDER BY i) signature FROM m GROUP BY 1""",
    }
