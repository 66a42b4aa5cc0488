"""Log lines and settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.functions import media


def log_lines(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows split at bars into ts, level, module and message; lines without a leading timestamp are left out."""
    parts = F.split(F.rtrim(F.col(text)), r"\s*\|\s*", 4)
    ts = F.try_to_timestamp(F.trim(parts[0]), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = rows.where(F.contains(text, F.lit("|"))).withColumns({"ts": ts, "level": F.try_element_at(parts, F.lit(2)), "module": F.try_element_at(parts, F.lit(3)), "message": F.try_element_at(parts, F.lit(4))})
    return out.where("ts IS NOT NULL")


def recent_lines(spark: SparkSession, path: str, now: float, hours: int = 24, most: int = 50) -> DataFrame:
    """The last lines of a log that are at most so old."""
    rows = log_lines(spark.read.text(path))
    since = F.timestamp_micros(F.lit(int((now - hours * 3600) * 1e6)))
    return rows.where(F.col("ts") >= since).orderBy(F.desc("ts"), F.desc("value")).limit(most)


def merged(defaults: dict, given: dict) -> dict:
    """given over defaults, section by section; keys that only one side has are kept."""
    return defaults | {k: merged(defaults[k], v) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in given.items()}


def settings(path: str, defaults: dict) -> dict:
    """The settings in a JSON file over the defaults; the defaults alone where the file is missing or broken."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return merged(defaults, {})
    return merged(defaults, given if isinstance(given, dict) else {})


def size_mb(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), media.megabytes(F.coalesce(F.sum("size"), F.lit(0))).alias("megabytes"))
