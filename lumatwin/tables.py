"""Reading the tables and taking the rows that count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.stage import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key, that of the largest version.

    Rows with a null key are no rows. Among rows of equal version the one with the largest other columns
    counts, so equal rows count once and the result doesn't depend on row order.
    """
    rest = [c for c in (columns or df.columns) if c not in (key, version)]
    best = F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, f"_best.{version}", *[f"_best.{c}" for c in rest])


def current_files(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The files table with one row per id, the one seen last."""
    return latest(table(spark, sf_dir, "files"), "id", "last_seen_at", columns)


def current_features(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The features table with one row per file_id, that of the highest feature_ver."""
    return latest(table(spark, sf_dir, "features"), "file_id", "feature_ver", columns)
