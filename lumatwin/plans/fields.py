"""Queries of column functions on files and exif rows, and of reports."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import reports, selection
from lumatwin.plans import sqltext as S
from lumatwin.plans.workflow import _MEM, files, members
from lumatwin.sources import texts
from lumatwin.tables import current_features, table

NOW = 1_764_547_200.0  # 2025-12-01


def exif_rows(spark: SparkSession, d: str):
    """One exif row per file; of different ones the largest."""
    e = table(spark, d, "exif")
    rest = [c for c in e.columns if c != "file_id"]
    return e.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(F.struct(*rest)).alias("e")).select("file_id", "e.*")


def scan_rules(spark, d):
    """What a scan makes of each path."""
    f, path = files(spark, d, "path", "dims_w", "dims_h"), F.col("path")
    ext = media.extension(path)
    return f.select(
        "file_id", media.matches(media.name_of(path), media.INCLUDE).alias("included"), media.in_cache_dir(path).alias("in_cache"), media.format_name(path).alias("format_name"), media.big_enough(F.col("dims_w"), F.col("dims_h")).alias("big_enough"),
        ext.isin(media.THUMB_FORMATS).alias("thumbable"), ext.isin(media.HEAVY_FORMATS).alias("heavy"),
    )


def format_priority(spark, d):
    p = media.format_priority(F.col("format"), F.col("path"))
    return files(spark, d, "path", "format", "dims_w", "dims_h", "exif_dt").select("file_id", p.alias("priority"), media.format_class(p).alias("class"), media.resolution(F.col("dims_w"), F.col("dims_h")).alias("resolution"), media.present(F.col("exif_dt")).alias("exif_dt"))


def cameras(spark, d):
    make, model = F.col("camera_make"), F.col("camera_model")
    return exif_rows(spark, d).select("file_id", media.camera(make, model).alias("camera"), media.camera_full(make, model).alias("camera_full"))


def orientation(spark, d):
    w, h = media.upright(F.col("dims_w"), F.col("dims_h"), F.col("orientation"))
    return files(spark, d, "dims_w", "dims_h", "orientation").select("file_id", w.alias("w"), h.alias("h"), media.orientation_steps(F.col("orientation")).alias("steps"))


def thumb_sizes(spark, d):
    w, h = media.thumb_size(F.col("dims_w"), F.col("dims_h"), 256)
    return files(spark, d, "path", "size", "mtime", "dims_w", "dims_h").select("file_id", w.alias("w"), h.alias("h"), media.thumb_name(F.col("path"), F.col("size"), F.col("mtime")).alias("thumb"))


def exif_times(spark, d):
    e = exif_rows(spark, d)
    return e.select("file_id", media.exif_seconds(F.col("datetime_original_raw")).alias("seconds"), media.zone_offset(F.col("timezone_offset")).alias("offset"), F.when(F.col("flash"), 1).otherwise(0).alias("flash"), media.flash_fired(F.coalesce("iso_speed", F.lit(0))).alias("odd_iso"))


def path_hashes(spark, d):
    """hashes of paths and texts."""
    return files(spark, d, "path").select("file_id", F.md5("path").alias("path_md5"), F.sha2("path", 256).alias("path_sha256"))


def text_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def name_patterns(spark, d):
    """on names built from path hashes and times."""
    f = files(spark, d, "path_hash", "last_seen_at")
    name = F.concat(F.lit("thumb_"), "path_hash", F.lit("_"), F.date_format(F.timestamp_seconds(F.lit(1_500_000_000) + F.col("file_id")), "yyyyMMdd_HHmmss"), F.lit(".webp"))
    return f.select("file_id", media.name_pattern(name).alias("pattern"), media.age_days(NOW, F.col("last_seen_at")).alias("age"))


def char_distance(spark, d):
    f = current_features(spark, d, ["file_id", "feature_ver", "phash", "dhash"])
    return f.select("file_id", media.char_distance(F.col("phash"), F.col("dhash")).alias("distance"))


def size_ratios(spark, d):
    """F30 within groups: how much each member's size differs from the first one's."""
    m = members(spark, d).join(files(spark, d, "size"), "file_id")
    first = m.groupBy("group_id").agg(F.min(F.struct("file_id", "size")).alias("f")).select("group_id", F.col("f.file_id").alias("first_id"), F.col("f.size").alias("first_size"))
    return m.join(first, "group_id").select("group_id", "file_id", F.round(media.size_ratio(F.col("size"), F.col("first_size")), 9).alias("ratio"))


def similar_lookup(spark, d):
    """Files of the size and fast_hash of some other file, by a join instead of a filter per file; the most recent first."""
    f = current_features(spark, d, ["file_id", "feature_ver", "fast_hash"]).where("fast_hash <> ''").join(files(spark, d, "size", "mtime"), "file_id")
    a, b = f.select(F.col("file_id").alias("asked"), "size", "fast_hash"), f.select(F.col("file_id").alias("found"), "size", "fast_hash", "mtime")
    return a.join(b, ["size", "fast_hash"]).where("asked <> found").select("asked", "found", "mtime")


def report(spark: SparkSession, d: str):
    exif = exif_rows(spark, d).select("file_id", "camera_make")
    return reports.pairs(members(spark, d), files(spark, d, "path", "size", "mtime", "dims_w", "dims_h", "exif_dt", "camera_model", "created_at"), current_features(spark, d, ["file_id", "feature_ver", "sha256", "phash"]), exif)


def report_rows(spark, d):
    return report(spark, d).select("group_id", "original_path", "duplicate_path", "tag", "reason", F.round("similarity_score", 6).alias("similarity_score"), "file_size", "original_size", "exif_match", "exif_differences", "camera_make", "date_taken", "resolution", "created_date")


def report_text(spark, d):
    rows = reports.as_text(report(spark, d), ["file_size", "notes"])
    return rows.toDF(*[c.lower().replace(" ", "_") for c in rows.columns])


def report_totals(spark, d):
    return reports.totals(report(spark, d))


def report_json(spark, d):
    rows = report(spark, d).select(*reports.chosen(["resolution"]))
    return rows.select("group_id", "duplicate_path", F.to_json(F.struct("group_id", "original_path", "duplicate_path", "tag", "reason")).alias("record"))


def report_touching(spark, d):
    """Report rows in which a promoted duplicate is on either side."""
    rows = report(spark, d).select("group_id", "original_path", "duplicate_path", "tag")
    picked = members(spark, d).where("role = 'safe_duplicate'").join(files(spark, d, "path"), "file_id").select("path")
    return selection.touching(rows, picked, "original_path", "duplicate_path")


def log_lines(spark, d):
    """The lines of all scan logs."""
    docs = table(spark, d, "documents").where("lower(trim(translate(source, '-', '_'))) = 'scan_logs'").select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "value"))
    return texts.log_lines(docs).select("doc_id", "line", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "level", "module")


def log_levels(spark, d):
    return log_lines(spark, d).groupBy("level").agg(F.count("*").alias("lines"), F.min("at").alias("first"), F.max("at").alias("last"))


def queries() -> dict:
    return {
        "s02_scan_rules": scan_rules, "p02_format_priority": format_priority, "f09_cameras": cameras, "f12_orientation": orientation, "f15_thumb_sizes": thumb_sizes, "f07_exif_times": exif_times, "f06_path_hashes": path_hashes, "f04_text_hashes": text_hashes,
        "f17_name_patterns": name_patterns, "f29_char_distance": char_distance, "f30_size_ratios": size_ratios, "p06_similar_lookup": similar_lookup, "j19_report_rows": report_rows, "k16_report_text": report_text, "k17_report_json": report_json, "k18_report_totals": report_totals,
        "p24_report_touching": report_touching, "s14_log_lines": log_lines, "s14_log_levels": log_levels,
    }


_C = f"WITH {S.CURRENT}"
_EX = f"WITH ex AS (SELECT file_id, unnest(max({{'a': datetime_original, 'b': datetime_original_raw, 'c': datetime_digitized, 'd': datetime_modified, 'camera_make': camera_make, 'camera_model': camera_model, 'e': camera_full, 'f': orientation, 'iso_speed': iso_speed, 'g': focal_length, 'h': f_number, 'i': exposure_time, 'flash': flash, 'j': width, 'k': height, 'timezone_offset': timezone_offset}})) FROM exif GROUP BY file_id)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_REP = f"""WITH {S.CURRENT}, {_MEM}, ft AS (SELECT file_id, sha256, phash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1), ex AS (SELECT file_id, max(camera_make) camera_make FROM exif GROUP BY 1),
fo AS (SELECT group_id, min(file_id) o_id FROM mem WHERE role = 'original' GROUP BY 1),
rp AS (SELECT m.group_id, o.path original_path, u.path duplicate_path, CASE m.role WHEN 'safe_duplicate' THEN 'safe_duplicate' ELSE 'duplicate' END tag, CASE WHEN coalesce(similarity_score, 0) * 100 > 99 THEN 'exact' ELSE 'near' END reason, coalesce(similarity_score, 0) * 100 score,
  u.size file_size, o.size original_size, (CASE WHEN o.exif_dt <> 0 AND NOT isnan(o.exif_dt) THEN o.exif_dt END) IS NOT DISTINCT FROM (CASE WHEN u.exif_dt <> 0 AND NOT isnan(u.exif_dt) THEN u.exif_dt END) st, lower(trim(coalesce(o.camera_model, ''))) = lower(trim(coalesce(u.camera_model, ''))) sc,
  camera_make, u.exif_dt, u.dims_w, u.dims_h, u.created_at, m.notes FROM mem m JOIN fo USING (group_id) JOIN cur o ON o.id = o_id JOIN cur u ON u.id = m.file_id LEFT JOIN ex ON ex.file_id = m.file_id WHERE m.role <> 'original')"""
_DAY = "CASE WHEN {0} BETWEEN 0 AND 4e9 THEN strftime(make_timestamp(floor({0} * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') END"
_LOG = r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) "value", unnest(range(len(string_split_regex(text, '\r\n|\r|\n')))) line FROM documents WHERE lower(trim(replace(source, '-', '_'))) = 'scan_logs' AND text IS NOT NULL),
p AS (SELECT doc_id, line, string_split_regex(rtrim("value", E' \t'), '\s*\|\s*') a FROM l WHERE contains("value", '|')),
lg AS (SELECT doc_id, line, trim(a[1]) AS "at", a[2] "level", a[3] module FROM p WHERE regexp_full_match(trim(a[1]), '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'))"""


def oracle_sql() -> dict[str, str]:
    ext = S.EXTENSION
    names = {"jpg": "JPEG", "tif": "TIFF"}
    include = _LIST([p[2:] for p in media.INCLUDE])
    caches = "[" + ", ".join(f"'{x}'" for x in media.CACHE_DIRS) + "]"
    pix = "CASE WHEN dims_w <> 0 AND dims_h <> 0 THEN dims_w::BIGINT * dims_h ELSE 0 END"
    prio = S.RANK.format(x=S.FORMAT)
    steps = {2: "mirror", 3: "rotate 180", 4: "mirror, rotate 180", 5: "mirror, rotate 90", 6: "rotate 270", 7: "mirror, rotate 270", 8: "rotate 90"}
    mk, md = "nullif(trim(camera_make), '')", "nullif(trim(camera_model), '')"
    return {
        "s02_scan_rules": f"{_C} SELECT id file_id, {ext} IN {include} included, list_has_any(string_split(lower(regexp_replace(path, '/[^/]*$', '')), '/'), {caches}) in_cache, CASE {ext} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} ELSE upper({ext}) END format_name, dims_w IS NULL OR dims_h IS NULL OR (dims_w >= 256 AND dims_h >= 256) big_enough, {ext} IN {_LIST(media.THUMB_FORMATS)} thumbable, {ext} IN {_LIST(media.HEAVY_FORMATS)} heavy FROM cur",
        "p02_format_priority": f"{_C} SELECT id file_id, {prio} priority, (['raw', 'tiff', 'png', 'jpeg', 'webp', 'other'])[{prio}] AS \"class\", {pix} resolution, CASE WHEN exif_dt <> 0 AND NOT isnan(exif_dt) THEN exif_dt END exif_dt FROM cur",
        "f09_cameras": _EX + f" SELECT file_id, nullif(concat_ws(' ', {mk}, {md}), '') camera, nullif(trim(concat_ws(' ', {mk}, CASE WHEN starts_with({md}, {mk}) THEN trim(substr({md}, length({mk}) + 1)) ELSE {md} END)), '') camera_full FROM ex",
        "f12_orientation": f"{_C} SELECT id file_id, CASE WHEN orientation BETWEEN 5 AND 8 THEN dims_h ELSE dims_w END w, CASE WHEN orientation BETWEEN 5 AND 8 THEN dims_w ELSE dims_h END h, CASE orientation {' '.join(f"WHEN {k} THEN '{v}'" for k, v in steps.items())} ELSE 'none' END steps FROM cur",
        "f15_thumb_sizes": f"{_C} SELECT id file_id, CASE WHEN dims_w > 0 AND dims_h > 0 THEN CASE WHEN dims_w >= dims_h THEN 256 ELSE greatest(1, floor(dims_w * (256.0::DOUBLE / dims_h)))::INT END END w, CASE WHEN dims_w > 0 AND dims_h > 0 THEN CASE WHEN dims_w >= dims_h THEN greatest(1, floor(dims_h * (256.0::DOUBLE / dims_w)))::INT ELSE 256 END END h, 'thumb_' || left(sha256(concat_ws(':', path, size::VARCHAR, floor(coalesce(mtime, 0))::BIGINT::VARCHAR)), 16) || '.webp' thumb FROM cur",
        "f07_exif_times": _EX + r""", t AS (SELECT *, trim(b, E' \t\n\r') r FROM ex) SELECT file_id, CASE WHEN regexp_full_match(r, '\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?') OR regexp_full_match(r, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') OR regexp_full_match(r, '\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}')
  THEN epoch_us(try_cast(substr(r, 1, 4) || '-' || substr(r, 6, 2) || '-' || substr(r, 9) AS TIMESTAMP)) / 1e6 END "seconds", nullif(regexp_extract(trim(timezone_offset, E' \t\n\r'), '^([+-]\d{2}:\d{2})$', 1), '') AS "offset", CASE WHEN flash THEN 1 ELSE 0 END flash, coalesce(iso_speed, 0) % 2 = 1 odd_iso FROM t""",
        "f06_path_hashes": f"{_C} SELECT id file_id, md5(path) path_md5, sha256(path) path_sha256 FROM cur",
        "f04_text_hashes": "SELECT doc_id, sha256(text) sha256 FROM documents",
        "f17_name_patterns": _C + r" SELECT id file_id, regexp_replace(regexp_replace('thumb_' || path_hash || '_' || strftime(make_timestamp((1500000000 + id) * 1000000), '%Y%m%d_%H%M%S') || '.webp', '_[a-f0-9]{8,}', '_HASH', 'g'), '_\d{8}_\d{6}', '_TIMESTAMP', 'g') pattern, floor((" + str(NOW) + " - last_seen_at) / 86400)::BIGINT age FROM cur",
        "f29_char_distance": "WITH f AS (SELECT file_id, phash p, dhash d FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) WHERE rn = 1) SELECT file_id, CASE WHEN p IS NOT NULL AND d IS NOT NULL THEN len(list_filter(range(1, least(length(p), length(d)) + 1), lambda k: substr(p, k, 1) <> substr(d, k, 1)))::INT END distance FROM f",
        "f30_size_ratios": f"WITH {S.CURRENT}, {_MEM}, m AS (SELECT group_id, file_id, size, first_value(size) OVER (PARTITION BY group_id ORDER BY file_id) fs FROM mem JOIN cur ON cur.id = mem.file_id) SELECT group_id, file_id, CASE WHEN size > 0 AND fs > 0 THEN round(abs(size - fs) / greatest(size, fs), 9) END ratio FROM m",
        "p06_similar_lookup": _C + ", f AS (SELECT id, size, mtime, fast_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY feature_ver DESC) rn FROM features) ft JOIN cur ON cur.id = ft.file_id WHERE rn = 1 AND fast_hash <> '') SELECT a.id asked, b.id found, b.mtime FROM f a JOIN f b ON a.size = b.size AND a.fast_hash = b.fast_hash AND a.id <> b.id",
        "j19_report_rows": _REP + f" SELECT group_id, original_path, duplicate_path, tag, reason, round(score, 6) similarity_score, file_size, original_size, st AND sc exif_match, concat_ws(', ', CASE WHEN NOT st THEN 'time' END, CASE WHEN NOT sc THEN 'camera' END) exif_differences, camera_make, {_DAY.format('exif_dt')} date_taken, dims_w || 'x' || dims_h resolution, {_DAY.format('created_at')} created_date FROM rp",
        "k16_report_text": _REP + " SELECT group_id::VARCHAR group_id, original_path, duplicate_path, tag, reason, printf('%.2f', score) similarity_score, coalesce(format('{:,}', file_size), '') file_size, 'none' action_taken, coalesce(notes, '') notes FROM rp",
        "k17_report_json": _REP + """ SELECT group_id, duplicate_path, '{"group_id":' || group_id || ',"original_path":"' || original_path || '","duplicate_path":"' || duplicate_path || '","tag":"' || tag || '","reason":"' || reason || '"}' record FROM rp""",
        "k18_report_totals": _REP + " SELECT tag, reason, count(*) pairs, count(DISTINCT group_id) \"groups\", coalesce(sum(file_size), 0)::BIGINT size FROM rp GROUP BY 1, 2",
        "p24_report_touching": _REP + ", pk AS (SELECT path FROM mem JOIN cur ON cur.id = mem.file_id WHERE role = 'safe_duplicate') SELECT DISTINCT group_id, original_path, duplicate_path, tag FROM rp WHERE original_path IN (SELECT path FROM pk) OR duplicate_path IN (SELECT path FROM pk)",
        "s14_log_lines": _LOG + " SELECT * FROM lg",
        "s14_log_levels": _LOG + ' SELECT "level", count(*) lines, min("at") AS first, max("at") AS last FROM lg GROUP BY 1',
    }
