"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumatwin-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package, once: they needn't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lumatwin", False):
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="lumatwin-code-")) / "lumatwin-code.zip"  # read by the driver only, which sends it on
    atexit.register(shutil.rmtree, at.parent, True)
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("lumatwin") / p.relative_to(here)))
    sc.addPyFile(str(at))
    sc._lumatwin = True


#: Folders of the operators that ran since the last release.
_ROOTS: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the intermediate tables of all operators so far and returns their number. To be called when their results are written: lazy results still read them."""
    gone = len(_ROOTS)
    while _ROOTS:
        _delete(spark, _ROOTS.pop())
    return gone


def _delete(spark: SparkSession, at: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stage:
    """Intermediate tables of one operator run; the ones no longer needed are dropped as it goes on."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        ship(spark)
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        _ROOTS.append(self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:04d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table: later plans start here, also after executors are lost."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._stage_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if at := getattr(df, "_stage_path", None):
                self.delete(at)

    def delete(self, at: str) -> None:
        _delete(self.spark, at)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least as many partitions as the session has cores, for work in Python."""
    ship(df.sparkSession)
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
