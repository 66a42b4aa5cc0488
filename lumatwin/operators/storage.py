"""Stored tables as snapshots: upserts, replacing groups, lookups, agreement of two groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """old with the rows of new in place of those with the same keys. Of several new rows of one key the largest counts (by version first, if given)."""
    rest = [c for c in old.columns if c not in keys]
    order = [version, *[c for c in rest if c != version]] if version else rest
    latest = new.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_n")).select(*keys, *[F.col(f"_n.{c}").alias(c) for c in rest])
    return old.join(latest.select(*keys), keys, "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def stored_groups(grouped: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """The groups and members tables that replace the stored ones, from the rows of grouping.two_tier.

    Exact groups keep their number; near ones follow them: ids are twice the smallest file of the group, plus 1 for near groups.
    """
    number = (F.col("group_no") * 2 + F.when(F.col("tier") == "near", 1).otherwise(0)).alias("group_id")
    rows = grouped.select(number, "tier", "file_id", "role", "confidence")
    text = F.format_string("confidence:%.3f|files:%d", "confidence", "files")
    groups = rows.groupBy("group_id", "tier").agg(F.first("confidence").alias("confidence"), F.count("*").alias("files"))
    groups = groups.select(F.col("group_id").alias("id"), F.concat("tier", F.lit("_duplicates")).alias("reason"), text.alias("score_summary"), F.lit(float(now)).alias("created_at"))
    score = F.when(F.col("role") == "original", 1.0).otherwise(F.col("confidence"))
    return groups, rows.select("group_id", "file_id", "role", score.alias("similarity_score"), F.lit(None).cast("string").alias("notes"))


def by_path(files: DataFrame, asked: DataFrame) -> DataFrame:
    """The files at the asked paths: joined on a short hash, and on the path itself in case hashes agree."""
    key = F.xxhash64("path")
    return files.withColumn("_h", key).join(asked.select("path").distinct().withColumn("_h", key), ["_h", "path"]).drop("_h").select(*files.columns)


def group_agreement(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: groups of either grouping(group_no, file_id), and those with the very same files in both.

    A group is known by its number of files and two sums of hashes of them, so no group is gathered in one place.
    """
    sign = lambda df: df.distinct().groupBy("group_no").agg(F.count("*").alias("n"), F.sum(F.xxhash64("file_id").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64("file_id", F.lit(1)).cast("decimal(20,0)")).alias("b"))
    x, y = sign(expected), sign(actual)
    same = x.join(y, ["n", "a", "b"], "left_semi").agg(F.count("*").alias("same"))
    return x.agg(F.count("*").alias("expected")).join(F.broadcast(y.agg(F.count("*").alias("actual")))).join(F.broadcast(same))  # one row each


def health(counts: DataFrame) -> DataFrame:
    """counts(files, db_mb, cache_mb) with the number of issues (nothing scanned, over 0.1 MB a file, cache over 5,000 MB) and a word for it."""
    issues = [F.col("files") == 0, F.coalesce(F.try_divide(F.col("db_mb"), F.col("files")) > 0.1, F.lit(False)), F.col("cache_mb") > 5000]
    n = sum((i.cast("int") for i in issues), F.lit(0))
    return counts.withColumn("issues", n).withColumn("health", F.element_at(F.array(*map(F.lit, ("excellent", "good", "fair", "poor"))), n + 1))
