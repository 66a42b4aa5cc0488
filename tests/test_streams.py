from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumatwin.streaming import streams


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, key long").coalesce(1).write.parquet(folder)
    return spark.readStream.schema("event_id long, ts timestamp, key long").parquet(folder)


T0 = dt.datetime(2024, 1, 1)


def test_rate_and_sessions(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(seconds=s), 1) for k, s in enumerate((0, 0.2, 0.9, 5, 5.5, 2000, 9000))]
    run(streams.rate(events(spark, str(tmp_path / "a"), rows)), "rate", "update")
    assert {(r.start.second, r.n) for r in spark.table("rate").where("start < '2024-01-01 00:00:10'").collect()} == {(0, 3), (5, 2)}
    run(streams.sessions(spark.readStream.schema("event_id long, ts timestamp, key long").parquet(str(tmp_path / "a"))), "sessions")
    assert {r.n for r in spark.table("sessions").collect()} <= {5, 1}


def test_back_off(spark, tmp_path):
    rows = [(k, T0 + dt.timedelta(seconds=s), k % 2) for k, s in enumerate((0, 0, 0.1, 0.1, 0.2, 5, 1.9, 5.1, 2.5, 5.2))]
    run(streams.back_off(events(spark, str(tmp_path / "b"), rows)), "busy", "append")
    got = {r.event_id: r.backed_off for r in spark.table("busy").collect()}
    from lumatwin.operators import telemetry

    expected = {r.event_id: r.backed_off for r in telemetry.back_off(spark.createDataFrame(rows, "event_id long, ts timestamp, key long")).collect()}
    assert got == expected and any(got.values()) and not all(got.values())


def test_snapshot_sink(spark, tmp_path):
    first = spark.createDataFrame([(1, "/a", 1, 1.0, "active", 0.0), (2, "/b", 1, 1.0, "active", 0.0)], "file_id long, path string, size long, mtime double, status string, last_seen_at double")
    sink = streams.SnapshotSink(spark, first)
    batch = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime double")
    sink(batch([("/a", 2, 5.0), ("/c", 3, 1.0)]), 0)
    sink(batch([("/d", 3, 1.0)]), 1)
    sink(batch([("/d", 3, 1.0)]), 1)  # run again
    expected = {(1, "/a", 2, "active"), (2, "/b", 1, "active"), (3, "/c", 3, "active"), (4, "/d", 3, "active")}
    assert {(r.file_id, r.path, r.size, r.status) for r in sink.current().collect()} == expected
    again = streams.SnapshotSink(spark, first.limit(0), sink.path)  # another session goes on
    again(batch([("/e", 9, 1.0)]), 2)
    assert {(r.file_id, r.path, r.size, r.status) for r in again.current().collect()} == expected | {(5, "/e", 9, "active")} and len(again._versions()) == 2


def test_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jpg").write_bytes(b"123")
    run(streams.listings(spark, str(tmp_path / "in")), "found")
    assert [(r.size, r.path.endswith("/x.jpg")) for r in spark.table("found").collect()] == [(3, True)]
    assert spark.table("found").select(F.max("mtime")).first()[0] > 1e9
