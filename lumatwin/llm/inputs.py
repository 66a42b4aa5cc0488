"""What the operators for training data read from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions.hashes import hash_long, hex_digits
from lumatwin.tables import current_features, table

PHASH_RADIUS = 6


def file_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, batch_no) of all files: the smallest batch that brought it, 0 if none did."""
    brought = table(spark, sf_dir, "batch_items").where("file_id IS NOT NULL AND batch_no >= 1").groupBy("file_id").agg(F.min("batch_no").alias("batch_no"))
    files = table(spark, sf_dir, "files").select(F.col("id").alias("file_id")).where("file_id IS NOT NULL").distinct()
    return files.join(brought, "file_id", "left").select("file_id", F.coalesce("batch_no", F.lit(0)).alias("batch_no"))


def file_hashes(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(file_id, ...) with the usable hashes of each file, null where unusable: sha256 as digits, the others as numbers."""
    read = {n: hex_digits(F.col(n), 64) if n == "sha256" else hash_long(F.col(n)) for n in names}
    return current_features(spark, sf_dir, ["file_id", "feature_ver", *names]).select("file_id", *[c.alias(n) for n, c in read.items()])
