"""Streams of files and events. Sinks are left to the caller; state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumatwin.operators import snapshots
from lumatwin.stage import Stage


def rate(events: DataFrame, span: str = "1 second", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events of each key in each window; events later than ``late`` don't count."""
    return events.withWatermark("ts", late).groupBy("key", F.window("ts", span, slide)).agg(F.count("*").alias("n")).select("key", F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of activity of each key, parted by idle gaps."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def back_off(events: DataFrame, seconds: float = 1.0, least: int = 3, hold: float = 2.0, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, backed_off) as operators.telemetry.back_off, for events(event_id long, ts, key long) that arrive in order of time for each key.

    The state of a key is the times of its last span and the last back-off; it's given up when the watermark is an hour past the key's last event.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, since = (list(state.get[0]), state.get[1]) if state.exists else ([], float("-inf"))
        for p in parts:
            p, out = p.sort_values(["ts", "event_id"]), []
            for t in p["ts"].map(lambda x: x.timestamp()):
                recent = [r for r in recent if r > t - seconds] + [t]
                busy = t - since < hold
                if not busy and len(recent) >= least:
                    busy, since = True, t
                out.append(busy)
            yield pd.DataFrame({"key": key[0], "event_id": p["event_id"].to_numpy(), "backed_off": out})
        state.update((recent, since))
        state.setTimeoutTimestamp(max(int(recent[-1] * 1000), state.getCurrentWatermarkMs()) + 3_600_000)

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key long, event_id long, backed_off boolean", "recent array<double>, since double", "append", GroupStateTimeout.EventTimeTimeout)


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they appear: path, size, mtime."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return found.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


class SnapshotSink:
    """foreachBatch sink that carries a snapshot table along: every batch of a listing makes the next version.

    Versions are folders below ``path`` (by default one of its own), so a sink that's made again at the same path goes on where the last one
    stopped, and ``first`` counts only where there is none yet. A batch that is run again (after a failure) starts from the version before it, so it
    counts once. The last two versions are kept.
    """

    def __init__(self, spark: SparkSession, first: DataFrame, path: str | None = None) -> None:
        self.spark, self.schema, self.stage = spark, first.schema, Stage(spark, "snapshot")
        self.path = path or self.stage.path("versions")
        if not self._versions():
            first.write.mode("overwrite").parquet(self._at(-1))

    def _at(self, number: int) -> str:
        return f"{self.path}/v{number + 1:012d}"

    def _versions(self) -> list[int]:
        """The batches of the versions that were written to the end."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[1:]) - 1 for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._at(number))

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self._read(max(k for k in self._versions() if k < number))
        seen = batch.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("s")).select("path", "s.size", "s.mtime")
        # files that the batch doesn't name are as they were: it's no listing of all files
        untouched = before.join(seen.select("path"), "path", "left_anti")
        touched = snapshots.merge(before, seen, float(number)).join(seen.select("path"), "path", "left_semi")
        untouched.unionByName(touched).write.mode("overwrite").parquet(self._at(number))
        for old in [k for k in self._versions() if k < number][:-1]:
            self.stage.delete(self._at(old))

    def current(self) -> DataFrame:
        return self._read(self._versions()[-1])
