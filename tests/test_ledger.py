"""Cache entries, thumbnails, deletions, names in quarantine, presets, exports: small cases, nulls, repeats, empty tables."""

from __future__ import annotations

import csv
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumatwin.operators import caches, presets, selection, signatures
from lumatwin.sinks import reports as sinks
from lumatwin.sources import images

ENTRIES = "key string, path string, size long, created_at double, last_accessed double, entry_type string"


def test_cache_entries(spark):
    old = spark.createDataFrame([("a", "/a", 1, 1.0, 1.0, "t"), ("b", "/b", 2, 1.0, 1.0, "t"), (None, "/n", 5, 1.0, 1.0, None)], ENTRIES)
    new = spark.createDataFrame([("b", "/b2", 7, "u"), ("c", "/c", 3, "u"), ("c", "/c", 3, "u"), (None, "/x", 1, "u")], "key string, path string, size long, entry_type string")
    rows = caches.add(old, new, 9.0)
    assert sorted(((r.key or "", r.path, r.created_at) for r in rows.collect())) == [("", "/n", 1.0), ("a", "/a", 1.0), ("b", "/b2", 9.0), ("c", "/c", 9.0)]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert {r.key: r.last_accessed for r in caches.touch(rows, keys("a", "a", "zz", None), 11.0).collect()} == {None: 1.0, "a": 11.0, "b": 9.0, "c": 9.0}
    assert {r.key for r in caches.remove(rows, keys("a", "c", "zz")).collect()} == {None, "b"}
    empty, gone = caches.clear(rows)
    assert empty.count() == 0 and gone.first().cleared_entries == 4
    assert caches.add(old.limit(0), new.limit(0), 1.0).count() == 0 and caches.clear(old.limit(0))[1].first()[:] == (0, 0.0)


def test_thumbs_that_are_asked_for(spark):
    schema = "file_id long, thumb_path string, thumb_w int, thumb_h int, created_at double, last_used_at double"
    old = spark.createDataFrame([(1, "x", 1, 1, 1.0, 1.0), (2, "y", 1, 1, 1.0, 1.0), (3, "z", 1, 1, 1.0, 1.0)], schema)
    can = spark.createDataFrame([(k, f"new{k}", 2, 2, None, None) for k in (2, 4, 6)], schema)
    asked = spark.createDataFrame([(1,), (2,), (4,), (4,), (5,), (None,)], "file_id long")
    got = {r.file_id: (r.thumb_path, r.created_at, r.last_used_at) for r in caches.thumbs_asked(old, asked, spark.createDataFrame([("x",)], "thumb_path string"), can, 8.0).collect()}
    assert got == {1: ("x", 1.0, 8.0), 2: ("new2", 8.0, 8.0), 3: ("z", 1.0, 1.0), 4: ("new4", 8.0, 8.0)}


def test_size_purge_keeps_four_fifths(spark):
    now, mb = 100 * 86_400.0, 1_048_576
    files = spark.createDataFrame([("thumbnail_1", 15 * mb, now - 5 * 86_400), ("thumbnail_2", 20 * mb, now - 10 * 86_400), ("thumbnail_3", 25 * mb, now - 2 * 86_400)], "path string, size long, mtime double")
    assert [r.path for r in caches.cleanup(files, "size_cap_breach", now, 50.0 * mb).collect()] == ["thumbnail_2"]
    assert caches.cleanup(files, "size_cap_breach", now, 60.0 * mb).count() == 0
    assert [r.path for r in caches.cleanup(files, "app_start", now, 0.0).collect()] == ["thumbnail_2"] and caches.cleanup(files, "manual", now, 0.0).count() == 0
    assert caches.cleanup(files.limit(0), "size_cap_breach", now, 1.0).count() == 0


def test_figures_are_saved_and_loaded(spark, tmp_path):
    files = spark.createDataFrame([("a", 5, 0.0), ("b", None, 86_400.0)], "path string, size long, mtime double")
    row = caches.figures(files, 90_000.0)
    sinks.save_figures(row, str(tmp_path / "f"))
    assert sinks.load_figures(spark, str(tmp_path / "f"), row.schema).first() == row.first() and row.first().oldest_file_date == "1970-01-01T00:00:00"
    assert sinks.load_figures(spark, str(tmp_path / "none"), row.schema).count() == 0
    (tmp_path / "broken").write_text("{")
    assert sinks.load_figures(spark, str(tmp_path / "broken"), row.schema).count() == 0


def names(spark, paths):
    got = selection.quarantine_names(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    return {r.path: r.stored_as for r in got}


def test_names_in_quarantine_never_meet(spark):
    assert names(spark, ["/a/x.jpg", "/b/x.jpg", "/c/x_1.jpg"]) == {"/a/x.jpg": "x.jpg", "/b/x.jpg": "x_2.jpg", "/c/x_1.jpg": "x_1.jpg"}
    paths = ["/a/x.jpg", "/b/x.jpg", "/c/x.jpg", "/d/x.jpg", "/e/x_2.jpg", "/f/x_2.jpg", "/g/x_2_1.jpg", "/h/x_4.jpg", "/i/x_01.jpg", "/j/x", "/k/x", "/l/x_1", "/m/.x", "/n/.x", "/o/y.tar.gz", "/p/y.tar.gz"]
    got = names(spark, [*paths, paths[0]])
    assert len(set(got.values())) == len(paths) == len(got)
    assert [got[p] for p in paths[:4]] == ["x.jpg", "x_1.jpg", "x_3.jpg", "x_5.jpg"] and got["/f/x_2.jpg"] == "x_2_2.jpg" and got["/k/x"] == "x_2" and got["/n/.x"] == ".x_1" and got["/p/y.tar.gz"] == "y.tar_1.gz"
    assert names(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_names_against_a_loop(spark, seed):
    rng = random.Random(seed)
    paths = sorted({f"/{rng.randint(0, 99):02d}/{rng.choice(['x', 'x', 'x_1', 'x_2', 'x_12', 'z'])}.{rng.choice(['a', 'b'])}" for _ in range(150)})
    own, used, expected = {p.rsplit("/", 1)[1] for p in paths}, set(), {}
    for p in sorted(paths, key=lambda p: (p.rsplit("/", 1)[1], p)):
        name = p.rsplit("/", 1)[1]
        stem, ext = name.rsplit(".", 1)
        k, new = 0, name
        while new in used or (k and new in own):
            k += 1
            new = f"{stem}_{k}.{ext}"
        used.add(new)
        expected[p] = new
    assert names(spark, paths) == expected


def test_ledger_and_undo(spark):
    files = spark.createDataFrame([(1, "/a", 10, "active"), (2, "/b", 20, "missing"), (3, "/c", None, "active"), (4, "/d", 5, None)], "file_id long, path string, size long, status string")
    batch, after = selection.ledger(files, spark.createDataFrame([(1,), (1,), (2,), (4,), (None,)], "file_id long"), "quarantine", 3)
    assert [tuple(r) for r in batch.collect()] == [(3, 1, "/a", 10, "quarantine")] and {r.file_id: r.status for r in after.collect()} == {1: "deleted", 2: "missing", 3: "active", 4: None}
    deleted = spark.createDataFrame([(1, "/a", 10, "quarantine"), (2, "/b", 20, "recycle"), (2, "/c", 5, "quarantine")], "batch_id int, path string, size long, method string")
    assert selection.undo_totals(deleted).first()[:] == (3, 35, 1, 5, 2, 30) and selection.undo_totals(deleted.limit(0)).first()[:] == (0, 0, 0, 0, 0, 0)


def test_exported_selection(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "/a,b.jpg", 5, "original", True), (1, 11, '/q"x.jpg', None, "safe_duplicate", True), (2, 12, "/c.jpg", 7, "duplicate", False)], "group_id long, file_id long, path string, size long, role string, selected boolean")
    sinks.selection_csv(rows, str(tmp_path / "csv"))
    lines = [r for p in sorted(Path(tmp_path / "csv").glob("*.csv")) for r in csv.reader(open(p, newline=""))]
    assert sorted(r for r in lines if r != sinks.SELECTION) == [["10", "1", "/a,b.jpg", "5", "original", "true", "false"], ["11", "1", '/q"x.jpg', "", "safe_duplicate", "true", "true"]]
    sinks.selection_json(rows, str(tmp_path / "json"), 5.0)
    info = json.loads(next(Path(tmp_path / "json/export_info").glob("*.json")).read_text())["export_info"]
    assert info["total_files"] == 2 and info["selection_stats"]["safe_selected"] == 1 and spark.read.json(str(tmp_path / "json/files")).count() == 2


def test_presets(spark):
    keys = list(presets.PRESETS["Balanced"])
    rows = [tuple(p.values()) for p in presets.PRESETS.values()] + [(None, *list(presets.PRESETS["Balanced"].values())[1:])]
    df = spark.createDataFrame(rows, "thread_cap int, io_throttle double, memory_cap_mb int, enable_orb_fallback boolean, on_demand_thumbs boolean, skip_raw_tiff boolean, cache_size_cap_mb int")
    assert [r.n for r in df.select(presets.preset_name({k: F.col(k) for k in keys}).alias("n")).collect()] == ["Ultra-Lite", "Balanced", "Accurate", "Custom"]
    assert df.limit(1).select(presets.preset_name({"thread_cap": F.col("thread_cap")}).alias("n")).first().n == "Custom"
    assert presets.radius("Accurate") == 12 and presets.radius("Accurate", low_power=True) == 6 and presets.session_settings("Balanced")["spark.executor.cores"] == "4"


def test_second_exif_reader(spark):
    schema = "file_id long, orientation int, camera_make string, camera_model string, camera_full string"
    first = spark.createDataFrame([(1, 6, None, None, None), (2, 1, None, None, None), (3, None, "A", "B", "A B"), (4, 99, None, None, ""), (5, 1, None, None, None)], schema)
    second = spark.createDataFrame([(1, 3, "M", "N", "M N"), (2, 3, "M", "N", "M N"), (3, 1, "M", "N", "M N"), (4, 0, "M", None, None), (9, 2, "M", "N", "M N")], schema)
    got = {r.file_id: tuple(r)[1:] for r in images.merged_exif(first, second).collect()}
    assert got == {1: (6, None, None, None), 2: (3, "M", "N", "M N"), 3: (1, "A", "B", "A B"), 4: (1, None, None, ""), 5: (1, None, None, None)}


def test_signatures(spark):
    df = spark.createDataFrame([(1, [0.0, 300.0]), (1, [4.0, 300.0]), (1, [2.0]), (1, None), (2, [None, 16.5]), (3, [])], "k long, d array<double>")
    assert {r.k: r.signature for r in signatures.moments(df, "k", "d").collect()} == {1: "02ff0100", 2: "1000"}
    assert signatures.moments(df.limit(0), "k", "d").count() == 0


def test_hashes_of_pixels():
    """Flat steps and ramps, a shift in brightness, and pictures unlike each other; the same values as by hand."""
    import numpy as np

    ramp = np.tile(np.arange(9) * 10, (8, 1))
    assert images.dhash(ramp) == "f" * 16 and images.dhash(ramp[:, ::-1]) == "0" * 16
    half = np.zeros((64, 64), np.uint8)
    half[:, 32:] = 200
    assert images.whash(half) == "0f" * 8
    rng = np.random.default_rng(2)
    coarse = rng.integers(0, 200, (8, 8))
    fine = lambda n: np.kron(coarse, np.ones((n, n))).astype(np.uint8)
    assert images.whash(fine(4)) == images.whash(fine(16)) == images.whash(fine(8) + 20)
    bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    p = images.phash(fine(4))
    assert bits(p, images.phash(fine(4) + 20)) <= 2 and bits(p, images.phash(np.clip(fine(4) + rng.normal(0, 3, (32, 32)), 0, 255))) <= 8 < bits(p, images.phash(rng.integers(0, 200, (32, 32))))


def test_exif_tags():
    got = images.exif_fields({274: 6, 36867: "2020:01:02 03:04:05", 271: " Orel ", 272: "K1\x00", 34855: "400", 37386: 35.5, 33437: "x", 33434: 0.004, 37385: 25, 36881: "+02:00"})
    assert got["orientation"] == 6 and got["taken"] == "2020:01:02 03:04:05" and got["camera_make"] == "Orel" and got["camera_model"] == "K1" and got["iso_speed"] == 400 and got["f_number"] is None and got["flash"] is True and got["timezone_offset"] == "+02:00"
    none = images.exif_fields({274: 77, 37385: 16, 36881: "local", 271: ""})
    assert none["orientation"] == 1 and none["flash"] is False and {k for k, v in none.items() if v is not None} == {"orientation", "flash"}


def test_unreadable_contents_are_null(spark):
    df = spark.createDataFrame([("/a.jpg", bytearray(b"no image")), ("/b.jpg", None)], "path string, content binary")
    rows = images.described(df).collect()
    assert len(rows) == 2 and all(r.width is None and r.whash is None for r in rows) and "content" not in rows[0]
