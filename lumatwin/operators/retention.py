"""What a cache or store of files may lose: by age, kind, name and size. Every function plans; nothing is deleted.

entries(key, path, size, created_at, last_accessed, entry_type); files(path, size, mtime). ``now`` is always given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators.ordered import running

HARD_DAYS, SOFT_DAYS = 30, 21


def expiry(now: float, hard_days: int = HARD_DAYS, soft_days: int = SOFT_DAYS):
    """hard, soft or live, by the time an entry was made."""
    made = F.col("created_at")
    return F.when(made < now - hard_days * media.DAY_S, "hard").when(made < now - soft_days * media.DAY_S, "soft").otherwise("live")


def stats(entries: DataFrame, now: float, cap: int) -> DataFrame:
    """(entry_type, entries, size, hard, soft, percent_of_cap): by type, and for all in a row of the type 'all'."""
    rows = entries.withColumn("e", expiry(now))
    sums = [F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count_if(F.col("e") == "hard").alias("hard"), F.count_if(F.col("e") == "soft").alias("soft")]
    by = rows.groupBy(F.coalesce("entry_type", F.lit("")).alias("entry_type")).agg(*sums)
    return by.union(rows.agg(*sums).select(F.lit("all"), "*")).withColumn("percent_of_cap", F.col("size") * 100.0 / cap)


def lru(entries: DataFrame, remove: float, most: int | None = None) -> DataFrame:
    """The entries used longest ago whose removal frees at least ``remove`` bytes: the one that reaches it is the last. most: at most so many, as a purge step may limit."""
    ranked = running(entries, [F.col("last_accessed"), F.col("key")], F.col("size"))
    hit = ranked.where(F.col("before") < remove)
    return (hit.where(F.col("place") <= most) if most else hit).drop("place", "before")


def purge(entries: DataFrame, now: float, cap: int, most: int | None = None) -> DataFrame:
    """(key, size, reason) of a purge: all hard-expired entries; then, if more than cap is left, the ones used longest ago down to 80 % of it (at most so many, if given);
    or, if less than half of cap was in use, half of the soft-expired ones in the order of their keys."""
    rows = entries.withColumn("e", expiry(now))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = rows.agg(zero(F.sum("size")).alias("_all"), zero(F.sum(F.when(F.col("e") == "hard", F.col("size")))).alias("_hard"), F.count_if(F.col("e") == "soft").alias("_soft"))
    hard = rows.where("e = 'hard'").select("key", "size", F.lit("hard_expired").alias("reason"))
    live = rows.where("e <> 'hard'")
    used = running(live, [F.col("last_accessed"), F.col("key")], F.col("size")).join(F.broadcast(sums))  # one row
    left = F.col("_all") - F.col("_hard")
    oldest = used.where((left > cap) & (F.col("before") < left - F.lit(cap * 0.8)))
    if most is not None:
        oldest = oldest.where(F.col("place") <= most)
    half = running(live.where("e = 'soft'"), [F.col("key")]).join(F.broadcast(sums)).where((F.col("_all") < cap * 0.5) & (F.col("place") <= F.floor(F.col("_soft") / 2)))  # one row
    return hard.union(oldest.select("key", "size", F.lit("lru"))).union(half.select("key", "size", F.lit("soft_expired")))


def oldest_beyond(files: DataFrame, total: DataFrame, now: float, cap: float, percent: float) -> DataFrame:
    """(path, size) of the files that go, oldest by whole days first, of one age the largest first, if total(total) is above cap bytes: down to so many percent of it."""
    ranked = running(files, [-media.age_days(now, F.col("mtime")), -F.coalesce("size", F.lit(0)), F.col("path")], F.col("size")).join(F.broadcast(total))  # one row
    return ranked.where((F.col("total") > cap) & (F.col("before") < F.col("total") - F.lit(cap * percent / 100))).select("path", "size")


def size_purge(files: DataFrame, now: float, remove: float) -> DataFrame:
    """The files that go to free ``remove`` bytes: oldest by whole days first, of one age the smallest first."""
    ranked = running(files, [-media.age_days(now, F.col("mtime")), F.coalesce("size", F.lit(0)), F.col("path")], F.col("size"))
    return ranked.where(F.col("before") < remove).select("path", "size", F.col("place").alias("rank"))


def sweep(files: DataFrame, now: float) -> DataFrame:
    """(path, fast, full): whether a fast sweep (older than a week) or a full one takes the file."""
    name, age = media.name_of(F.col("path")), media.age_days(now, F.col("mtime"))
    full = (age > 30) | (F.col("size") == 0) | media.is_broken(name) | (media.is_temporary(name) & (age > 1))
    false = F.lit(False)
    return files.select("path", F.coalesce(age > 7, false).alias("fast"), F.coalesce(full, false).alias("full"))


def keep_newest(files: DataFrame) -> DataFrame:
    """(path, pattern, kept): of the files of one folder and name pattern the newest is kept; of equal times the first path."""
    pattern = F.concat(media.folder_of(F.col("path")), F.lit("/"), media.name_pattern(media.name_of(F.col("path"))))
    rows = files.select("path", "mtime", pattern.alias("pattern"))
    # the newest by aggregation, so that a pattern with most files isn't sorted in one task
    best = rows.groupBy("pattern").agg(F.min(F.struct((-F.col("mtime")).alias("m"), "path")).alias("b")).select("pattern", F.col("b.path").alias("best"))
    return rows.join(best, "pattern").select("path", "pattern", (F.col("path") == F.col("best")).alias("kept"))


def reclaimable(files: DataFrame, now: float) -> DataFrame:
    """One row: files that could go, and their MB: old ones, all but the newest of a pattern among the others, and temporary ones (counted on top, so some count twice)."""
    age = media.age_days(now, F.col("mtime"))
    rows = files.select("path", "size", "mtime", age.alias("age"))
    young = rows.where("age <= 30")
    older = young.join(keep_newest(young).where("NOT kept").select("path"), "path").select("size")
    temporary = young.where(media.is_temporary(media.name_of(F.col("path"))) & (F.col("age") > 1)).select("size")
    all_ = rows.where("age > 30").select("size").union(older).union(temporary)
    return all_.agg(F.count("*").alias("files"), media.megabytes(F.coalesce(F.sum("size"), F.lit(0))).alias("megabytes"))


def fragmentation(files: DataFrame, now: float) -> DataFrame:
    """One row: files, bytes, first and last time, and a measure from 0 to 1 of how far ages and sizes spread; 0 for fewer than 10 files."""
    age, size = media.age_days(now, F.col("mtime")).cast("double"), F.col("size").cast("double")
    level = (F.least(F.var_pop(age) / 100, F.lit(1.0)) + F.least(F.var_pop(size) / 1_048_576, F.lit(1.0))) / 2
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"), F.when(F.count("*") < 10, 0.0).otherwise(level).alias("fragmentation"))


def advice(stats: DataFrame, cap_mb: float, now: float) -> DataFrame:
    """stats(total_mb, reclaimable_mb, fragmentation, last_cleanup) with what should be done."""
    due = F.col("last_cleanup").isNull() | (media.age_days(now, F.col("last_cleanup")) > 7)
    what = F.when(F.col("total_mb") > cap_mb, "purge").when(F.col("reclaimable_mb") > 100, "cleanup").when(F.col("fragmentation") > 0.7, "defragment").when(due, "maintain").otherwise("healthy")
    return stats.withColumn("advice", what)


def orphans(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files without a row that names them."""
    return listing.join(known.select("path").distinct(), "path", "left_anti")


def newest(rows: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first n rows of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
