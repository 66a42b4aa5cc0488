"""Figures on operations over time. events(event_id, ts, key, value); ts with or without a time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatwin.operators.ordered import chunked, running
from lumatwin.stage import ship


def _us():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def summary(events: DataFrame) -> DataFrame:
    """Per key: count, total, smallest, largest and mean value."""
    return events.groupBy("key").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"))


def _in_order(events: DataFrame, halo: int) -> DataFrame:
    """events in chunks of their order by key and time, so that a key with most events is many tasks."""
    return chunked(events.select("event_id", "ts", "key", "value"), [F.col(c) for c in ("key", "ts", "event_id")], halo)


def rolling(events: DataFrame, last: int = 100) -> DataFrame:
    """Mean and 95th percentile (the value at place floor(0.95 n) of n sorted ones, counted from 0) of the last values of each key, up to each event."""
    w = Window.partitionBy("chunk", "key").orderBy("place").rowsBetween(-(last - 1), 0)
    rows = _in_order(events, last - 1).withColumns({"recent": F.collect_list("value").over(w), "mean": F.avg("value").over(w)}).where("NOT halo")
    n = F.size("recent")
    at = F.least(F.floor(n * 95 / 100).cast("int"), n - 1)
    return rows.select("event_id", "key", "mean", F.try_element_at(F.array_sort("recent"), at + 1).alias("p95"))


def rate(events: DataFrame, seconds: float, least: int) -> DataFrame:
    """Events of the key within the trailing span at each event (of one moment all count), and whether they're at least so many.

    Time is cut into stretches; each also gets the events of the span before it.
    """
    span = int(seconds * 1e6)
    stretch = span * 1000
    us = _us()
    own = F.floor(us / stretch).cast("long")
    copies = F.when(us % stretch > stretch - span, F.array(F.struct(own.alias("s"), F.lit(False).alias("halo")), F.struct((own + 1).alias("s"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(own.alias("s"), F.lit(False).alias("halo"))))
    rows = events.select("event_id", "key", us.alias("us"), F.explode(copies).alias("c")).select("event_id", "key", "us", "c.*")
    w = Window.partitionBy("key", "s").orderBy("us").rangeBetween(-span + 1, 0)
    return rows.withColumn("recent", F.count("*").over(w)).where("NOT halo").select("event_id", "key", "recent", (F.col("recent") >= least).alias("busy"))


def throttle(events: DataFrame, per_second: float) -> DataFrame:
    """Seconds that each event would have had to wait so that its key's events keep a rate; 0 for the first."""
    w = Window.partitionBy("chunk", "key").orderBy("place")
    gap = (_us() - F.lag(_us()).over(w)) / 1e6
    rows = _in_order(events, 1).withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(1.0 / per_second) - gap), F.lit(0.0)))
    return rows.where("NOT halo").select("event_id", "key", "wait")


def back_off(events: DataFrame, seconds: float = 1.0, least: int = 3, hold: float = 2.0) -> DataFrame:
    """(event_id, key, backed_off): a state per key: when the trailing span holds ``least`` events, it backs off for ``hold`` seconds; events meanwhile don't prolong it.

    Where a key is idle for the span and the hold, its state starts anew: stretches between such gaps are worked on apart, so a key with most events
    is many tasks. Events of a stretch go through in order of time, one Arrow batch after the other; only the times of the span and the last back-off
    are kept, so a stretch of any length needs little memory.
    """
    import pyarrow as pa

    ship(events.sparkSession)

    def run(batches):
        key, recent, since = object(), [], float("-inf")
        for x in batches:
            out = []
            for k, us in zip(x["_stretch"].to_pylist(), x["us"].to_pylist()):
                t = us / 1e6
                if k != key:
                    key, recent, since = k, [], float("-inf")
                recent = [r for r in recent if r > t - seconds] + [t]
                busy = t - since < hold
                if not busy and len(recent) >= least:
                    busy, since = True, t
                out.append(busy)
            yield pa.RecordBatch.from_arrays([x["event_id"], x["key"], pa.array(out, pa.bool_())], ["event_id", "key", "backed_off"])

    timed = events.select("event_id", "key", _us().alias("us"))
    order = [F.col(c) for c in ("key", "us", "event_id")]
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("chunk", "key").orderBy("place"))
    starts = chunked(timed, order, 1).withColumn("_new", F.coalesce(gap >= int(max(seconds, hold) * 1e6), F.lit(True)).cast("int")).where("NOT halo").select("event_id", "key", "us", "_new")
    rows = running(starts, order, F.col("_new")).select("event_id", "key", "us", (F.col("before") + F.col("_new")).alias("_stretch"))
    rows = rows.repartition("_stretch").sortWithinPartitions("_stretch", "us", "event_id").select("event_id", "key", "us", "_stretch")
    return rows.mapInArrow(run, f"event_id long, key {events.schema['key'].dataType.simpleString()}, backed_off boolean")


def recent(events: DataFrame, n: int) -> DataFrame:
    """The last n events of each key."""
    w = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Spans of activity of each key, parted by idle gaps: first and last moment and number of events."""
    return events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def outcomes(events: DataFrame, passed, failed) -> DataFrame:
    """One row: events that passed, failed or neither, and the share of passed ones in percent."""
    p, f = F.count_if(passed), F.count_if(failed)
    return events.agg(F.count("*").alias("total"), p.alias("passed"), f.alias("failed"), (F.count("*") - p - f).alias("skipped"), F.coalesce(F.try_divide(p * 100.0, F.count("*")), F.lit(0.0)).alias("percent"))
