from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lumatwin.functions import media
from lumatwin.operators import escalation, grouping, ordered, overrides, reports, retention, selection, snapshots, telemetry
from lumatwin.sinks import reports as sinks
from lumatwin.sources import images, listing, texts

FILES = "file_id long, path string, size long, mtime double, dims_w int, dims_h int, exif_dt double, format string, fast_hash string, sha256 string, phash string, dhash string, whash string"


def files(spark, rows):
    return spark.createDataFrame(rows, FILES)


def row(k, path=None, size=100, w=100, h=100, exif=None, fmt="JPEG", fast="aa", sha="bb", p=None, d=None, wh=None):
    return (k, path or f"/p/{k}.jpg", size, 0.0, w, h, exif, fmt, fast, sha, p, d, wh)


# --- grouping ---


@pytest.mark.parametrize(
    ("rows", "first"),
    [
        ([row(1, w=100, h=100), row(2, w=200, h=150), row(3, w=150, h=100)], 2),
        ([row(1, exif=9e8), row(2, exif=8e8), row(3)], 2),
        ([row(1, size=500), row(2, size=1500), row(3, size=1000)], 2),
        ([row(1, fmt="jpeg"), row(2, fmt="png"), row(3, fmt="cr2"), row(4, fmt="tiff"), row(5, fmt="webp")], 3),
        ([row(1, "/zebra.jpg"), row(2, "/alpha.jpg"), row(3, "/beta.jpg")], 2),
        ([row(1, size=5000), row(2, w=300, h=200, exif=9e8), row(3, w=300, h=200, exif=8e8, fmt="jpeg"), row(4, w=300, h=200, exif=8e8, fmt="png")], 4),
        ([row(1, w=None), row(2, w=0), row(3, w=10, h=10, size=None)], 3),
    ],
)
def test_original(spark, rows, first):
    members = spark.createDataFrame([(7, r[0]) for r in rows] + [(7, 999)], "group_no long, file_id long")
    assert [tuple(r) for r in grouping.originals(members, files(spark, rows)).collect()] == [(7, first)]


def test_exact_groups(spark):
    rows = [row(1), row(2), row(3, sha="cc"), row(4, size=1), row(5, fast=""), row(6, fast=None), row(7, sha=None), row(8, size=None)]
    got = {(r.group_no, r.file_id) for r in grouping.exact_groups(files(spark, rows)).collect()}
    assert got == {(1, 1), (1, 2)}
    got = {(r.group_no, r.file_id, r.confidence) for r in grouping.exact_groups(files(spark, rows), confirm=False).collect()}
    assert got == {(1, k, 0.95) for k in (1, 2, 3, 7)}
    assert grouping.exact_groups(files(spark, [])).count() == 0


def greedy(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    done, out = set(), set()
    for k in sorted(near):
        if k in done:
            continue
        mine = [j for j in near[k] if j not in done]
        if mine:
            done |= {k, *mine}
            out |= {(k, k), *((k, j) for j in mine)}
    return out


@pytest.mark.parametrize(("seed", "block"), [*((k, None) for k in range(4)), *((k, 20) for k in range(4))])
def test_leaders_against_greedy_loop(spark, monkeypatch, seed, block):
    if block:  # several ranges and rounds
        monkeypatch.setattr(grouping, "BLOCK_EDGES", block)
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range((30, 60, 90, 150)[seed])}
    df = spark.createDataFrame([(b, a, 1) if rng.random() < 0.5 else (a, b, 1) for a, b in edges], "a long, b long, distance int")
    assert {(r.leader, r.file_id) for r in grouping.leader_groups(spark, df).collect()} == greedy(edges)


def test_leaders_are_no_components(spark):
    run = lambda e: {(r.leader, r.file_id) for r in grouping.leader_groups(spark, spark.createDataFrame(e, "a long, b long, distance int")).collect()}
    assert run([(1, 2, 3), (2, 3, 3)]) == {(1, 1), (1, 2)}
    assert run([(1, 3, 3), (2, 3, 3)]) == {(1, 1), (1, 3)}
    assert run([]) == set() and run([(4, 4, 0)]) == set()


@pytest.mark.parametrize("block", [500_000, 2])
def test_leader_whose_smaller_neighbour_is_taken(spark, monkeypatch, block):
    """2 is free to lead as 1 goes to 0, and takes 5 although 3 could."""
    monkeypatch.setattr(grouping, "BLOCK_EDGES", block)
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 5, 4), (3, 5, 2)], "a long, b long, distance int")
    assert {(r.leader, r.file_id, r.distance) for r in grouping.leader_groups(spark, df).collect()} == {(0, 0, None), (0, 1, 1), (2, 2, None), (2, 5, 4)}


@pytest.mark.parametrize("block", [500_000, 25_000])
def test_long_chain_and_hubs(spark, monkeypatch, block):
    """A chain of 100,000 consecutive ids takes no more rounds than ranges; a file with a third of the edges is no hindrance on either end."""
    monkeypatch.setattr(grouping, "BLOCK_EDGES", block)
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = spark.range(200_001, 240_000).select(F.lit(200_000).cast("long").alias("a"), F.col("id").alias("b"))
    into = spark.range(300_000, 340_000).select(F.col("id").alias("a"), F.lit(400_000).cast("long").alias("b"))
    got = grouping.leader_groups(spark, chain.union(out).union(into).withColumn("distance", F.lit(1)))
    assert got.where(f"leader < {n}").groupBy().agg(F.count("*"), F.countDistinct("leader")).first()[:] == (n, n // 2) and got.where(f"leader < {n} AND leader % 2 = 1").count() == 0
    assert got.where("leader = 200000").count() == 40_000 and [r.file_id for r in got.where("leader >= 300000").orderBy("file_id").collect()] == [300_000, 400_000]


def test_copies_make_no_pairs(spark, monkeypatch):
    """Of files that are alike only the first is compared: 300 of them, one near to them, and a pair whose sides differ."""
    h = lambda bits: f"{0x0F1E2D3C4B5A6978 ^ ((1 << bits) - 1):016x}"
    rows = [row(k, p=h(0)) for k in range(10, 310)] + [row(5, p=h(3)), row(400, p="ffff0000ffff0000"), row(401, p="ffff0000ffff0000"), row(500, p=h(0), w=9000)]
    edges = []
    monkeypatch.setattr(grouping, "near_edges", lambda *a, _f=grouping.near_edges, **k: edges.append(_f(*a, **k)) or edges[-1])
    got = {(r.group_no, r.file_id): r.confidence for r in grouping.near_groups(spark, files(spark, rows), 8).collect()}
    assert set(got) == {(5, k) for k in (5, *range(10, 310))} | {(400, 400), (400, 401)} and edges[0].count() == 1
    assert got[5, 10] == pytest.approx(1 - 3 / 8) and got[400, 401] == 1.0


def test_near_groups_and_confidence(spark):
    h = lambda bits: f"{0x0F1E2D3C4B5A6978 ^ ((1 << bits) - 1):016x}"
    rows = [row(1, p=h(0)), row(2, p=h(2)), row(3, p=h(0), w=300), row(4, p="0" * 16), row(5, p="0" * 16), row(6, p=None), row(7, p=h(8), w=None)]
    got = {(r.group_no, r.file_id): r.confidence for r in grouping.near_groups(spark, files(spark, rows), 8).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 7)} and got[1, 1] == pytest.approx(1 - 2 / 8)


# --- escalation, overrides ---


def test_escalation_cases(spark):
    m, f = [], []
    cases = [(1, True, "Canon", "Canon", True), (2, True, "Nikon", "Nikon ", True), (3, True, "Sony", "Sony", False), (1, False, "C", "C", False), (1, True, None, "", True), (1, True, "a", None, False)]
    for g, (delta, same, a, b, _) in enumerate(cases):
        m += [(g, 10 * g, "original"), (g, 10 * g + 1, "duplicate")]
        f += [(10 * g, 100, 1000.0, a), (10 * g + 1, 100 if same else 99, 1000.0 + delta, b)]
    m += [(90, 901, "duplicate"), (91, 911, "original"), (91, 912, "safe_duplicate"), (92, 921, "original"), (92, 922, "duplicate")]
    f += [(921, 0, None, None), (922, 0, None, None)]
    members = spark.createDataFrame(m, "group_id long, file_id long, role string")
    known = spark.createDataFrame(f, "file_id long, size long, exif_dt double, camera_model string")
    got = {r.group_id: r for r in escalation.escalate(members, known).collect()}
    assert [got[g].new_role == "safe_duplicate" for g in range(len(cases))] == [c[-1] for c in cases]
    assert set(got) == {*range(len(cases)), 92} and got[92].criteria == "camera_model"
    loose = {r.group_id: r for r in escalation.escalate(members, known, check_camera=False).collect()}
    assert loose[92].datetime_match and not loose[92].size_match
    whole = escalation.summarise(escalation.escalate(members, known)).first()
    assert (whole.total_analyzed, whole.safe_duplicates_found, whole.groups_affected) == (7, 3, 3)
    assert escalation.summarise(escalation.escalate(members.limit(0), known)).first().escalation_rate == 0.0


def test_overrides(spark):
    schema = "override_id long, group_id long, original_file_id long, auto_original_id long, override_type string, reason string, created_at double, is_active boolean"
    old = spark.createDataFrame([(1, 1, 100, 101, "single_group", "user_preference", 5.0, True), (2, 2, 999, 201, "default_rule", "quality_better", 5.0, True)], schema)
    members = spark.createDataFrame([(1, 100), (1, 101), (2, 200), (2, 201)], "group_id long, file_id long")
    auto = spark.createDataFrame([(1, 101), (2, 201)], "group_id long, original_id long")
    got = {r.group_id: (r.original_id, r.by_hand, r.conflict) for r in overrides.apply(auto, members, old).collect()}
    assert got == {1: (100, True, "differs"), 2: (201, False, "gone")}
    new = spark.createDataFrame([(3, 1, 101, 101, "single_group", "user_preference", 6.0, True), (4, 2, 555, 201, "single_group", "user_preference", 6.0, True)], schema)
    history = overrides.record(old, new.drop("is_active"), members)
    assert {r.override_id: r.is_active for r in history.collect()} == {1: False, 2: True, 3: True}
    roles = spark.createDataFrame([(1, 100, "original"), (1, 101, "safe_duplicate"), (3, 5, "x")], "group_id long, file_id long, role string")
    assert {(r.file_id, r.role) for r in overrides.set_roles(roles, auto).collect()} == {(100, "duplicate"), (101, "original"), (5, "x")}
    gone = overrides.missing_originals(old, spark.createDataFrame([(100, "active"), (999, "deleted")], "file_id long, status string")).collect()
    assert [r.group_id for r in gone] == [2]
    stats = {(r.what, r.name): r.n for r in overrides.stats(history).collect()}
    assert stats["total", "all"] == 3 and stats["total", "active"] == 2 and stats["type", "default_rule"] == 1


# --- snapshots ---


def test_delta(spark):
    old = spark.createDataFrame([(1, "/a", 10, 100.0, "active", 1.0), (2, "/b", 10, 100.0, "active", 1.0), (3, "/c", 10, 100.0, "active", 1.0), (4, "/d", 10, 100.0, "deleted", 1.0), (5, "/e", None, None, "missing", 1.0)], "file_id long, path string, size long, mtime double, status string, last_seen_at double")
    new = spark.createDataFrame([("/a", 10, 100.999), ("/b", 10, 101.0), ("/c", 11, 100.0), ("/e", None, None), ("/y", 1, 1.0), ("/x", 2, 2.0)], "path string, size long, mtime double")
    changes = snapshots.diff(old, new)
    assert {r.path: r.change for r in changes.collect()} == {"/a": "unchanged", "/b": "changed", "/c": "changed", "/d": "missing", "/e": "unchanged", "/x": "new", "/y": "new"}
    after = {r.path: r for r in snapshots.merge(old, new, 50.0).collect()}
    assert {p: (r.file_id, r.status, r.last_seen_at) for p, r in after.items()} == {
        "/a": (1, "active", 50.0), "/b": (2, "active", 50.0), "/c": (3, "active", 50.0), "/d": (4, "deleted", 1.0), "/e": (5, "missing", 50.0), "/x": (6, "active", 50.0), "/y": (7, "active", 50.0),
    }
    f = spark.createDataFrame([(1,), (2,)], "file_id long")
    stats = snapshots.stats(snapshots.work(changes, f, f), seconds=10).first()
    assert (stats.files_new, stats.files_changed, stats.files_unchanged, stats.files_missing, stats.files_processed) == (2, 2, 2, 1, 5)
    assert snapshots.merge(old.limit(0), new, 1.0).count() == 6 and snapshots.merge(old, new.limit(0), 1.0).where("status = 'missing'").count() == 4


@pytest.mark.parametrize(("total", "features", "thumbs", "which"), [(100, 60, 55, "full_rebuild"), (100, 5, 2, "missing_features"), (100, 0, 0, "delta_only"), (0, 0, 0, "delta_only")])
def test_recommendation(spark, total, features, thumbs, which):
    f = spark.range(total).select(F.col("id").alias("file_id"), F.lit("active").alias("status"))
    has = lambda n: spark.range(n, total).select(F.col("id").alias("file_id"))
    got = snapshots.recommend(f, has(features), has(thumbs)).first()
    assert (got.total_files, got.missing_features, got.missing_thumbs, got.recommended) == (total, features, thumbs, which)


def test_mark_missing_takes_whole_folders(spark):
    f = spark.createDataFrame([("/a/b/1", 1.0), ("/a/bc/2", 1.0), ("/a/b/3", 9.0), ("/A/b/4", 1.0)], "path string, last_seen_at double").withColumn("status", F.lit("active"))
    assert {r.path for r in snapshots.mark_missing(f, "/a/b", 5.0).where("status = 'missing'").collect()} == {"/a/b/1"}


# --- order ---


def test_running_and_chunks(spark, monkeypatch):
    rng = random.Random(1)
    values = [(k, rng.randint(0, 50), rng.choice([None, rng.randint(1, 9)])) for k in range(500)]
    df = spark.createDataFrame(values, "k long, o int, v long").repartition(7)
    got = {r.k: (r.place, r.before) for r in ordered.running(df, [F.col("o"), F.col("k")], F.col("v")).collect()}
    total = 0
    for n, (k, _, v) in enumerate(sorted(values, key=lambda r: (r[1], r[0]))):
        assert got[k] == (n + 1, total)
        total += v or 0
    monkeypatch.setattr(ordered, "CHUNK", 64)
    rows = ordered.chunked(df, [F.col("o"), F.col("k")], 9).collect()
    assert sum(not r.halo for r in rows) == 500 and sum(r.halo for r in rows) == 7 * 9
    assert ordered.running(df.limit(0), [F.col("k")]).count() == 0


def test_rolling_in_chunks_equals_whole_windows(spark, monkeypatch):
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    events = [(k, t0 + dt.timedelta(seconds=rng.randint(0, 400)), rng.choice("aab"), rng.random()) for k in range(600)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, key string, value double")
    monkeypatch.setattr(ordered, "CHUNK", 150)
    got = {r.event_id: (r.mean, r.p95) for r in telemetry.rolling(df).collect()}
    for key in "ab":
        mine = sorted((e for e in events if e[2] == key), key=lambda e: (e[1], e[0]))
        for n, e in enumerate(mine):
            last = sorted(x[3] for x in mine[max(0, n - 99) : n + 1])
            assert got[e[0]][0] == pytest.approx(sum(last) / len(last)) and got[e[0]][1] == last[min(int(len(last) * 0.95), len(last) - 1)]


def test_back_off_against_loop(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    events = [(k, t0 + dt.timedelta(milliseconds=rng.randint(0, 60_000)), rng.randint(1, 3), 0.0) for k in range(300)]
    got = {r.event_id: r.backed_off for r in telemetry.back_off(spark.createDataFrame(events, "event_id long, ts timestamp, key long, value double")).collect()}
    for key in (1, 2, 3):
        recent, since = [], -1e18
        for k, t, _, _ in sorted((e for e in events if e[2] == key), key=lambda e: (e[1], e[0])):
            s = (t - t0).total_seconds()
            recent = [r for r in recent if r > s - 1.0] + [s]
            busy = s - since < 2.0
            if not busy and len(recent) >= 3:
                busy, since = True, s
            assert got[k] == busy


# --- retention ---


def test_size_purge(spark):
    f = spark.createDataFrame([("thumbnail_1", 15, -5 * 86400.0), ("thumbnail_2", 20, -10 * 86400.0), ("thumbnail_3", 25, -2 * 86400.0)], "path string, size long, mtime double")
    assert [r.path for r in retention.size_purge(f, 0.0, 20).collect()] == ["thumbnail_2"]
    assert {r.path for r in retention.size_purge(f, 0.0, 21).collect()} == {"thumbnail_2", "thumbnail_1"}
    assert retention.size_purge(f, 0.0, 0).count() == 0


def test_keep_newest_and_reclaimable(spark):
    day = 86_400.0
    f = spark.createDataFrame([("/c/a_0123456789.webp", 1, -1 * day), ("/c/a_abcdef0123.webp", 2, -2 * day), ("/d/a_abcdef0123.webp", 4, -2 * day), ("/c/old.webp", 8, -40 * day), ("/c/x.tmp", 16, -3 * day), ("/c/x.tmp2", 0, 0.0)], "path string, size long, mtime double")
    assert {r.path for r in retention.keep_newest(f).where("NOT kept").collect()} == {"/c/a_abcdef0123.webp"}
    assert tuple(retention.reclaimable(f, 0.0).first()) == (3, pytest.approx(26 / 1_048_576))
    swept = {r.path: (r.fast, r.full) for r in retention.sweep(f, 0.0).collect()}
    assert swept["/c/old.webp"] == (True, True) and swept["/c/x.tmp"] == (False, True) and swept["/c/x.tmp2"] == (False, True) and swept["/d/a_abcdef0123.webp"] == (False, False)


# --- selection, reports, sinks ---


def test_quarantine_names(spark):
    df = spark.createDataFrame([("/a/x.jpg",), ("/b/x.jpg",), ("/c/x.jpg",), ("/a/.hidden",), ("/b/.hidden",), ("/a/y",)], "path string")
    assert {r.path: r.stored_as for r in selection.quarantine_names(df).collect()} == {"/a/x.jpg": "x.jpg", "/b/x.jpg": "x_1.jpg", "/c/x.jpg": "x_2.jpg", "/a/.hidden": ".hidden", "/b/.hidden": ".hidden_1", "/a/y": "y"}


def test_report_files(spark, tmp_path):
    members = spark.createDataFrame([(1, 1, "original", 1.0, None), (1, 2, "duplicate", 0.5, 'a "quoted", note'), (1, 3, "safe_duplicate", 1.0, ""), (2, 4, "duplicate", None, None)], "group_id long, file_id long, role string, similarity_score double, notes string")
    f = files(spark, [row(k, size=1_234_567 * k) for k in (1, 2, 3, 4)]).withColumns({"camera_model": F.lit("C"), "created_at": F.lit(0.0)}).drop("sha256", "phash")
    features = spark.createDataFrame([(2, "s", "p")], "file_id long, sha256 string, phash string")
    exif = spark.createDataFrame([(3, "Make")], "file_id long, camera_make string")
    rows = reports.pairs(members, f, features, exif)
    sinks.to_csv(rows, str(tmp_path / "csv"), ["file_size", "notes"], single=True)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').collect()
    assert len(back) == 2 and {r["File Size"] for r in back} == {"2,469,134", "3,703,701"} and 'a "quoted", note' in {r["Notes"] for r in back}
    sinks.both(rows, str(tmp_path / "both"), ["resolution"])
    meta = spark.read.json(str(tmp_path / "both/json/metadata")).first().metadata
    assert meta.total_records == 2 and set(reports.REQUIRED) < set(meta.fields) and "notes" not in meta.fields
    assert spark.read.json(str(tmp_path / "both/json/records")).count() == 2
    deleted = spark.createDataFrame([(1, "/a", 5, "quarantine"), (1, "/b", 6, "recycle"), (2, "/c", 7, "quarantine")], "batch_id long, path string, size long, method string")
    sinks.history(deleted, str(tmp_path / "history"))
    assert {(r.batch_id, r.files, len(r.deleted)) for r in spark.read.json(str(tmp_path / "history")).collect()} == {(1, 2, 2), (2, 1, 1)}
    assert [(r.path, r.restorable) for r in selection.undo_last(deleted).collect()] == [("/c", True)]
    sinks.compact(deleted, str(tmp_path / "compact"), 2)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 3


def test_selection(spark):
    rows = spark.createDataFrame([(1, 1, 10, "original", False), (1, 2, 20, "duplicate", True), (1, 3, 40, "safe_duplicate", True), (2, 4, 80, "duplicate", False)], "group_id long, file_id long, size long, role string, selected boolean")
    assert tuple(selection.stats(rows).first()) == (2, 1, 1, 1, 60, 20)
    assert {r.group_id: r.state for r in selection.group_state(rows).collect()} == {1: "partial", 2: "none"}
    assert tuple(selection.stats(rows.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


# --- sources ---


def test_scan(spark, tmp_path):
    for name in ("a.JPG", "b.png", "note.txt", "sub/c.tif", "cache/d.jpg", "sub/.thumbnails/e.jpg", "f.tmp.jpg"):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    got = {r.path.removeprefix(str(tmp_path / "in") + "/"): r for r in listing.scan(spark, str(tmp_path / "in"), exclude=["*.tmp.*"]).collect()}
    assert {k: r.format for k, r in got.items()} == {"a.JPG": "JPEG", "b.png": "PNG", "sub/c.tif": "TIFF"} and got["b.png"].size == 5
    assert listing.scan(spark, str(tmp_path / "in"), recursive=False, include=["?.jp[gh]", "b*"]).count() == 2
    hashed = listing.hashed(listing.scan(spark, str(tmp_path / "in"), content=True))
    import hashlib

    assert {r.sha256 for r in hashed.where("path LIKE '%b.png'").collect()} == {hashlib.sha256(b"b.png").hexdigest()}
    assert listing.counters(spark, str(tmp_path / "in")).first().kept == 4
    shown = images.described(listing.scan(spark, str(tmp_path / "in"), content=True)).collect()
    assert len(shown) == 4 and all(r.width is None for r in shown)


def test_logs_and_settings(spark, tmp_path):
    (tmp_path / "log").write_text("2025-06-10 01:00:00 | ERROR    | scan | one | more\nno time | x\n2025-06-09 00:00:00 | INFO | a | old\n2025-13-40 00:00:00 | X | b | bad\nplain\n\n")
    now = dt.datetime(2025, 6, 10, 2, tzinfo=dt.timezone.utc).timestamp()
    got = texts.recent_lines(spark, str(tmp_path / "log"), now).collect()
    assert [(r.level, r.module, r.message) for r in got] == [("ERROR", "scan", "one | more")]
    defaults = {"a": 1, "s": {"x": 1, "y": 2}}
    (tmp_path / "s.json").write_text(json.dumps({"s": {"y": 3}, "z": 4}))
    assert texts.settings(str(tmp_path / "s.json"), defaults) == {"a": 1, "s": {"x": 1, "y": 3}, "z": 4}
    (tmp_path / "bad.json").write_text("{")
    assert texts.settings(str(tmp_path / "bad.json"), defaults) == defaults == texts.settings(str(tmp_path / "none"), defaults)


def test_media_fields(spark):
    df = spark.createDataFrame([("/a/b.tar.JPG", "cr2", 4000, 3000, 6), ("/a/noext", None, 0, 5, 99), ("/.git/x.png", "", None, None, None), (None, None, None, None, None)], "path string, format string, w int, h int, o int")
    w, h = media.upright(F.col("w"), F.col("h"), F.col("o"))
    tw, th = media.thumb_size(F.col("w"), F.col("h"), 256)
    got = df.select(media.extension(F.col("path")), media.format_priority(F.col("format"), F.col("path")), media.resolution(F.col("w"), F.col("h")), w, h, tw, th, media.in_cache_dir(F.col("path"))).collect()
    assert [tuple(r) for r in got[:3]] == [("jpg", 1, 12_000_000, 3000, 4000, 256, 192, False), ("", 6, 0, 0, 5, None, None, False), ("png", 3, 0, None, None, None, None, True)]
    assert media.glob_regex(["a*.[jp]pg", "x?"]) == r"^(?:a.*\.[jp]pg|x.)$"
