"""Queries on retention and on figures over time.

The files stand for the entries of a cache (made when first recorded, used when last seen, of the type of their format), and the
texts of albums for its files; events are the operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import retention, telemetry
from lumatwin.plans import sqltext as S
from lumatwin.tables import current_files, table

NOW = 1_764_547_200.0  # 2025-12-01
CAP = 4_000_000_000


def entries(spark: SparkSession, d: str) -> DataFrame:
    return current_files(spark, d, ["id", "last_seen_at", "path_hash", "path", "size", "created_at", "format"]).select("path_hash", "path", F.when(F.col("size") >= 0, F.col("size")).otherwise(0).alias("size"), "created_at", F.col("last_seen_at").alias("last_accessed"), F.col("format").alias("entry_type")).withColumnRenamed("path_hash", "key")


def cache_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with the time they were last seen as their age."""
    return current_files(spark, d, ["id", "last_seen_at", "path", "size"]).select("path", F.when(F.col("size") >= 0, F.col("size")).otherwise(0).alias("size"), F.col("last_seen_at").alias("mtime"))


def operations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("key"), "value")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("key"), "value")


def cache_stats(spark, d):
    return retention.stats(entries(spark, d), NOW, CAP)


def cache_expiry(spark, d):
    return entries(spark, d).select("key", retention.expiry(NOW).alias("expiry"))


def lru_purge(spark, d):
    return retention.lru(entries(spark, d), 2e9).select("key", "size")


def purge_plan(spark, d):
    """I04 with the step's limit of 1,000 entries."""
    return retention.purge(entries(spark, d), NOW, CAP, 1000)


def whole_purge_plan(spark, d):
    """I04 until the cap is met, however many entries it takes."""
    return retention.purge(entries(spark, d), NOW, CAP)


def soft_purge_plan(spark, d):
    """The same where the cap is far off, so soft-expired entries go."""
    return retention.purge(entries(spark, d), NOW, 10**15, 1000)


def size_purge(spark, d):
    return retention.size_purge(cache_files(spark, d), NOW, 2e9)


def sweep(spark, d):
    return retention.sweep(cache_files(spark, d), NOW)


def keep_newest(spark, d):
    """W04 on names whose serial numbers are cut off, so that many files share a pattern."""
    f = cache_files(spark, d)
    return retention.keep_newest(f.withColumn("path", F.regexp_replace("path", r"[0-9a-z]+(\.[^./]*)$", "deadbeef$1")).groupBy("path", "mtime").agg(F.max("size").alias("size")))


def reclaimable(spark, d):
    return retention.reclaimable(cache_files(spark, d), NOW).select("files", F.round("megabytes", 6).alias("megabytes"))


def fragmentation(spark, d):
    return retention.fragmentation(cache_files(spark, d), NOW).withColumn("fragmentation", F.round("fragmentation", 9))


def advice(spark, d):
    f = cache_files(spark, d)
    total = retention.fragmentation(f, NOW).select((F.col("size") / 1_048_576).alias("total_mb"), "fragmentation", F.col("newest").alias("last_cleanup"))
    rows = total.join(F.broadcast(retention.reclaimable(f, NOW).select(F.col("megabytes").alias("reclaimable_mb"))))  # one row each
    return retention.advice(rows, 1e9, NOW).select(F.round("total_mb", 6).alias("total_mb"), "advice")


def orphans(spark, d):
    """Listed files without an exif row."""
    f = current_files(spark, d, ["id", "last_seen_at", "path"])
    known = f.join(table(spark, d, "exif").select(F.col("file_id").alias("id")).distinct(), "id").select("path")
    return retention.orphans(f.select("path"), known)


def profiler_summary(spark, d):
    s = telemetry.summary(operations(spark, d))
    return s.select("key", "n", *[F.round(c, 6).alias(c) for c in ("total", "least", "most", "mean")])


def rolling(spark, d):
    return telemetry.rolling(operations(spark, d)).select("event_id", "key", F.round("mean", 9).alias("mean"), F.round("p95", 9).alias("p95"))


def interaction_rate(spark, d):
    return telemetry.rate(interactions(spark, d), 3600.0, 3)


def throttle(spark, d):
    return telemetry.throttle(interactions(spark, d), 1 / 3600).select("event_id", "key", F.round("wait", 6).alias("wait"))


def back_off(spark, d):
    return telemetry.back_off(interactions(spark, d), seconds=3600.0, least=3, hold=7200.0)


def recent(spark, d):
    return telemetry.recent(operations(spark, d), 10).select("event_id", "key", "place")


def sessions(spark, d):
    return telemetry.sessions(interactions(spark, d), "10 hours")


def outcomes(spark, d):
    e = table(spark, d, "events")
    return telemetry.outcomes(e, F.col("event_type") == "purchase", F.col("event_type") == "error")


def pool_stats(spark, d):
    """Events, keys and the mean value over all, as the mean of the keys' means weighted by their events."""
    by = operations(spark, d).groupBy("key").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return by.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"))


def batches(spark, d):
    """Which batch of 50 each file is worked on in, by id."""
    from lumatwin.operators.ordered import running

    f = current_files(spark, d, ["id", "last_seen_at"]).select(F.col("id").alias("file_id"))
    return running(f, [F.col("file_id")]).select("file_id", F.floor((F.col("place") - 1) / 50).alias("batch"))


def queries() -> dict:
    return {
        "a10_cache_stats": cache_stats, "p22_cache_expiry": cache_expiry, "w02_lru_purge": lru_purge, "i04_purge_plan": purge_plan, "i04_whole_purge": whole_purge_plan, "w11_soft_purge_plan": soft_purge_plan, "w03_size_purge": size_purge, "p20_sweep": sweep, "w04_keep_newest": keep_newest,
        "a15_reclaimable": reclaimable, "a16_fragmentation": fragmentation, "f25_advice": advice, "j15_orphans": orphans, "a18_profiler_summary": profiler_summary, "w05_rolling_p95": rolling, "w07_interaction_rate": interaction_rate, "w08_throttle_delay": throttle,
        "w07_back_off": back_off, "w10_recent": recent, "i05_idle_sessions": sessions, "a22_outcomes": outcomes, "a23_pool_stats": pool_stats, "w09_batches": batches,
    }


_ENT = f"WITH {S.CURRENT}, en AS (SELECT path_hash AS key, path, CASE WHEN size >= 0 THEN size ELSE 0 END size, created_at, last_seen_at last_accessed, format entry_type, CASE WHEN created_at < {NOW} - 30 * 86400 THEN 'hard' WHEN created_at < {NOW} - 21 * 86400 THEN 'soft' ELSE 'live' END e FROM cur)"
_FIL = f"WITH {S.CURRENT}, cf AS (SELECT path, regexp_extract(path, '[^/]*$') nm, CASE WHEN size >= 0 THEN size ELSE 0 END size, last_seen_at mtime, floor(({NOW} - last_seen_at) / 86400) age FROM cur)"
_PATTERN = "regexp_replace(regexp_replace({}, '_[a-f0-9]{{8,}}', '_HASH', 'g'), '_\\d{{8}}_\\d{{6}}', '_TIMESTAMP', 'g')"
_TEMP = "(" + " OR ".join(f"contains(lower(nm), '{m}')" for m in media.TEMPORARY) + ")"
_BROKEN = "(" + " OR ".join(f"contains(lower(nm), '{m}')" for m in media.BROKEN) + ")"
_REC = f"""{_FIL}, rk AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') || '/' || {_PATTERN.format("nm")} ORDER BY mtime DESC, path) k FROM cf WHERE age <= 30),
go AS (SELECT size FROM cf WHERE age > 30 UNION ALL SELECT size FROM rk WHERE k > 1 UNION ALL SELECT size FROM rk WHERE age > 1 AND {_TEMP})"""


def _purge(cap: int, most: str = "AND k <= 1000") -> str:
    return f"""{_ENT}, lv AS (SELECT * FROM en WHERE e <> 'hard'), t AS (SELECT sum(size) a, (SELECT sum(size) FROM lv) l FROM en),
r AS (SELECT key, size, coalesce(sum(size) OVER (ORDER BY last_accessed, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, row_number() OVER (ORDER BY last_accessed, key) k FROM lv),
sf AS (SELECT key, size, row_number() OVER (ORDER BY key) k, count(*) OVER () n FROM en WHERE e = 'soft')
SELECT key, size, 'hard_expired' reason FROM en WHERE e = 'hard' UNION ALL SELECT key, size, 'lru' FROM r, t WHERE l > {cap} AND b < l - {cap} * 0.8 {most}
UNION ALL SELECT key, size, 'soft_expired' FROM sf, t WHERE a < {cap} * 0.5 AND k <= n // 2"""


def oracle_sql() -> dict[str, str]:
    sums = f"count(*) entries, coalesce(sum(size), 0)::BIGINT size, count(*) FILTER (e = 'hard') hard, count(*) FILTER (e = 'soft') soft, coalesce(sum(size), 0) * 100.0::DOUBLE / {CAP} percent_of_cap"
    ev = "SELECT event_id, ts, {} AS key, value FROM events"
    micros = "epoch_us(ts)"
    return {
        "a10_cache_stats": _ENT + f" SELECT coalesce(entry_type, '') entry_type, {sums} FROM en GROUP BY 1 UNION ALL SELECT 'all', {sums} FROM en",
        "p22_cache_expiry": _ENT + " SELECT key, e expiry FROM en",
        "w02_lru_purge": _ENT + ", r AS (SELECT key, size, coalesce(sum(size) OVER (ORDER BY last_accessed, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b FROM en) SELECT key, size FROM r WHERE b < 2000000000",
        "i04_purge_plan": _purge(CAP),
        "i04_whole_purge": _purge(CAP, ""),
        "w11_soft_purge_plan": _purge(10**15),
        "w03_size_purge": _FIL + ", r AS (SELECT path, size, coalesce(sum(size) OVER (ORDER BY age DESC, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) b, row_number() OVER (ORDER BY age DESC, size, path) rank FROM cf) SELECT path, size, rank FROM r WHERE b < 2000000000",
        "p20_sweep": _FIL + f" SELECT path, age > 7 fast, age > 30 OR size = 0 OR {_BROKEN} OR ({_TEMP} AND age > 1) \"full\" FROM cf",
        "w04_keep_newest": _FIL + r""", g AS (SELECT regexp_replace(path, '[0-9a-z]+(\.[^./]*)$', 'deadbeef\1') path, mtime FROM cf GROUP BY 1, 2), p AS (SELECT path, mtime, regexp_replace(path, '/[^/]*$', '') || '/' || """ + _PATTERN.format("regexp_extract(path, '[^/]*$')") + " pattern FROM g) SELECT path, pattern, path = first_value(path) OVER (PARTITION BY pattern ORDER BY mtime DESC, path) kept FROM p",
        "a15_reclaimable": _REC + " SELECT count(*) files, round(coalesce(sum(size), 0) / 1048576.0::DOUBLE, 6) megabytes FROM go",
        "a16_fragmentation": _FIL + " SELECT count(*) files, sum(size)::BIGINT size, min(mtime) oldest, max(mtime) newest, CASE WHEN count(*) < 10 THEN 0 ELSE round((least(var_pop(age) / 100, 1) + least(var_pop(size) / 1048576, 1)) / 2, 9) END fragmentation FROM cf",
        "f25_advice": _REC + f", t AS (SELECT sum(size) / 1048576.0::DOUBLE total_mb, max(mtime) m, (least(var_pop(age) / 100, 1) + least(var_pop(size) / 1048576, 1)) / 2 f, (SELECT sum(size) / 1048576.0 FROM go) r FROM cf) SELECT round(total_mb, 6) total_mb, CASE WHEN total_mb > 1e9 THEN 'purge' WHEN r > 100 THEN 'cleanup' WHEN f > 0.7 THEN 'defragment' WHEN m IS NULL OR floor(({NOW} - m) / 86400) > 7 THEN 'maintain' ELSE 'healthy' END advice FROM t",
        "j15_orphans": f"WITH {S.CURRENT} SELECT path FROM cur WHERE id NOT IN (SELECT file_id FROM exif)",
        "a18_profiler_summary": "SELECT event_type AS key, count(value) n, round(sum(value), 6) total, round(min(value), 6) least, round(max(value), 6) most, round(avg(value), 6) mean FROM events GROUP BY 1",
        "w05_rolling_p95": f"WITH e AS ({ev.format('event_type')}), w AS (SELECT event_id, key, avg(value) OVER q mean, list_sort(list(value) OVER q) l FROM e WINDOW q AS (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) SELECT event_id, key, round(mean, 9) mean, round(l[least(len(l) * 95 // 100, len(l) - 1) + 1], 9) p95 FROM w",
        "w07_interaction_rate": f"WITH e AS ({ev.format('user_id')}) SELECT event_id, key, count(*) OVER q recent, count(*) OVER q >= 3 busy FROM e WINDOW q AS (PARTITION BY key ORDER BY {micros} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)",
        "w08_throttle_delay": f"WITH e AS ({ev.format('user_id')}) SELECT event_id, key, round(coalesce(greatest(0, 3600.0::DOUBLE - ({micros} - lag({micros}) OVER (PARTITION BY key ORDER BY ts, event_id)) / 1e6), 0), 6) wait FROM e",
        "w07_back_off": f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS key, {micros} / 1e6::DOUBLE t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events),
st AS (SELECT 0::BIGINT event_id, key, 0::BIGINT rn, []::DOUBLE[] r, -1e300::DOUBLE since, false backed_off FROM (SELECT DISTINCT key FROM e)
  UNION ALL SELECT event_id, key, rn, r, CASE WHEN NOT held AND len(r) >= 3 THEN t ELSE since END, held OR len(r) >= 3
  FROM (SELECT e.event_id, e.key, e.rn, e.t, list_append(list_filter(st.r, lambda x: x > e.t - 3600), e.t) r, st.since, e.t - st.since < 7200 held FROM st JOIN e ON e.key IS NOT DISTINCT FROM st.key AND e.rn = st.rn + 1))
SELECT event_id, key, backed_off FROM st WHERE rn > 0""",
        "w10_recent": "SELECT event_id, event_type AS key, place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) place FROM events) WHERE place <= 10",
        "i05_idle_sessions": f"WITH e AS ({ev.format('user_id')}), l AS (SELECT *, coalesce({micros} - lag({micros}) OVER (PARTITION BY key ORDER BY ts, event_id) >= 36000000000, true)::INT s FROM e), g AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY ts, event_id) g FROM l) SELECT key, count(*) n, min(ts) AS first, max(ts) AS last FROM g GROUP BY key, g",
        "a22_outcomes": "SELECT count(*) total, count(*) FILTER (event_type = 'purchase') passed, count(*) FILTER (event_type = 'error') failed, count(*) FILTER (event_type NOT IN ('purchase', 'error')) skipped, count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / count(*) percent FROM events",
        "a23_pool_stats": "SELECT count(value) n, count(DISTINCT event_type) keys, round(sum(value) / count(value), 6) mean FROM events",
        "w09_batches": f"WITH {S.CURRENT} SELECT id file_id, (row_number() OVER (ORDER BY id) - 1) // 50 batch FROM cur",
    }
