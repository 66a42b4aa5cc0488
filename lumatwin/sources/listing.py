"""Listing files of folders: names, sizes and times, and their contents only where hashes are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media


def scan(spark: SparkSession, folder: str, recursive: bool = True, include: list[str] | None = None, exclude: list[str] | None = None, content: bool = False) -> DataFrame:
    """(path, size, mtime, format[, content]) of the files whose name matches an include and no exclude pattern, outside cache folders.

    Contents aren't read unless asked for: the column is pruned from the scan. An empty folder gives an empty result.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(folder if recursive else folder.rstrip("/") + "/*")
    path = F.regexp_replace("path", "^file:/*(?=/)", "")
    name = media.name_of(F.col("path"))
    keep = media.matches(name, media.INCLUDE if include is None else include) & ~media.in_cache_dir(F.col("path"))
    if exclude:
        keep &= ~media.matches(name, exclude)
    columns = [path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), media.format_name(F.col("path")).alias("format")]
    return found.where(keep).select(*columns, *([F.col("content")] if content else []))


def hashed(files: DataFrame) -> DataFrame:
    """scan(content=True) with the hashes of the contents and of the path, without the contents."""
    return files.withColumns({"fast_hash": F.lpad(F.lower(F.hex(F.xxhash64("content"))), 16, "0"), "sha256": F.sha2("content", 256), "path_hash": F.md5("path")}).drop("content")


def counters(spark: SparkSession, folder: str) -> DataFrame:
    """One row: files found, kept by the patterns, and skipped."""
    every = scan(spark, folder, include=["*"]).agg(F.count("*").alias("found"))
    return every.join(F.broadcast(scan(spark, folder).agg(F.count("*").alias("kept")))).withColumn("skipped", F.col("found") - F.col("kept"))  # one row each
