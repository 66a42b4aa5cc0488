from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumatwin.operators import timestamps as T

UTC = dt.timezone.utc


def us(*args) -> int:
    return int(dt.datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000


CASES = [
    ("2020:06:15 15:40:08", us(2020, 6, 15, 15, 40, 8), ""), ("2020-06-15T15:40:08", us(2020, 6, 15, 15, 40, 8), ""), ("2020/06/15  15:40:08 ", us(2020, 6, 15, 15, 40, 8), ""), ("2020-06-15T15:40", us(2020, 6, 15, 15, 40), ""),
    ("2020:06:15 15:40:08.5", us(2020, 6, 15, 15, 40, 8) + 500_000, ""), ("2020:06:15 15:40:08,123456", us(2020, 6, 15, 15, 40, 8) + 123_456, ""), ("20200615T154008Z", us(2020, 6, 15, 15, 40, 8), "Z"), ("20200615154008", us(2020, 6, 15, 15, 40, 8), ""),
    ("2020-06-15T15:40:08.123456789+05:30", us(2020, 6, 15, 15, 40, 8) + 123_456, "+05:30"), ("2020-06-15 15:40:08 GMT", us(2020, 6, 15, 15, 40, 8), "GMT"), ("Mon, 15 Jun 2020 15:40:08 -0230", us(2020, 6, 15, 15, 40, 8), "-0230"),
    ("Jun 15, 2020 3:40:08 PM", us(2020, 6, 15, 15, 40, 8), ""), ("Jun 5, 2020 12:00:01 AM", us(2020, 6, 5, 0, 0, 1), ""), ("06/15/2020 03:40:08 pm", us(2020, 6, 15, 15, 40, 8), ""), ("15/06/2020 15:40:08", us(2020, 6, 15, 15, 40, 8), ""),
    ("15.06.2020 15:40", us(2020, 6, 15, 15, 40), ""), ("\t2020:06:15 15:40:08\n", us(2020, 6, 15, 15, 40, 8), ""),
    ("2021:13:05 08:00:00", None, None), ("2019:02:30 11:20:00", None, None), ("2017:06:30 25:61:00", None, None), ("0000:00:00 00:00:00", None, None), ("    :  :     :  :  ", None, None), ("yesterday", None, None), ("", None, None), (None, None, None),
    ("2014:04", None, None), ("13:00 PM", None, None), ("x" * 50_000, None, None),
]


def test_parsing(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(CASES)], "k int, t string")
    got = {r.k: r for r in T.with_local(df, "t").collect()}
    for k, (text, local, zone) in enumerate(CASES):
        assert got[k].local_us == local, text
        if local is not None:
            assert got[k].zone_text == zone, text
    numbers = spark.createDataFrame([("1592235608",), ("1592235608123",), ("159223560812",)], "t string")
    assert [r.epoch_ms for r in T.with_local(numbers, "t").collect()][:2] == [1592235608000, 1592235608123]


def test_offsets(spark):
    cases = {"+05:30": 330, "-0400": -240, "+02": 120, "Z": 0, " -02:30 ": -150, "−05:00": -300, "UTC+01:00": 60, "GMT-10:00": -600, "+14:00": 840, "+14:01": None, "+25:00": None, "+99:99": None, "+05:75": None, "local": None, "--:--": None, "": None, "?": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.m for r in df.select("t", T.offset_minutes(F.col("t")).alias("m")).collect()} == cases


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu"])
def test_repeated_and_skipped_hours(spark, zone):
    z, rows = ZoneInfo(zone), []
    for day in range(0, 365 * 2, 1):
        for hour in (0, 1, 2, 3):
            for minute in (15, 45):
                rows.append(dt.datetime(2020, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute))
    df = spark.createDataFrame([(int(x.replace(tzinfo=UTC).timestamp()) * 1_000_000,) for x in rows], "l long")
    got = {r.l: r.u for r in df.select("l", T.local_to_utc_us(F.col("l"), F.lit(zone)).alias("u")).collect()}
    for x in rows:
        # fold=0: the first occurrence of a repeated time; of a skipped one the offset before the change
        expected = int(x.replace(tzinfo=z, fold=0).timestamp()) * 1_000_000
        assert got[int(x.replace(tzinfo=UTC).timestamp()) * 1_000_000] == expected, x


def test_longest_whole_folder_wins(spark):
    files = spark.createDataFrame([(1, "/a/b/c.jpg"), (2, "/a/bc/d.jpg"), (3, "/x/y.jpg"), (4, "/a/b/in/z.jpg"), (5, "plain.jpg"), (6, "/a/b")], "file_id long, path string")
    places = spark.createDataFrame([("/a/b", 1), ("/a", 2), ("/a/b/in/", 3), (None, 4)], "root string, place int")
    assert {r.file_id: r.place for r in T.owners(files, places).collect()} == {1: 1, 2: 2, 3: None, 4: 3, 5: None, 6: 2}


def test_zones_are_estimated(spark):
    rows = []
    for place, zone in (("b", "Europe/Berlin"), ("n", "America/New_York"), ("l", "Australia/Lord_Howe")):
        for day in range(0, 360, 3):
            local = dt.datetime(2019, 1, 1, 12) + dt.timedelta(days=day)
            instant = int(local.replace(tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000
            anchor = instant if day % 4 else instant + 86_400_000_000  # some anchors are wrong
            rows.append((place, int(local.replace(tzinfo=UTC).timestamp()) * 1_000_000, anchor if day % 5 else None, instant + 3_600_000_000))
    rows.append((None, None, None, None))
    samples = spark.createDataFrame(rows, "place string, local_us long, anchor_us long, ingested_us long")
    found = T.estimate_zones(samples, ["UTC", "Europe/London", "Europe/Berlin", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe"])
    assert {r.place: r.zone for r in found.where("place IS NOT NULL").collect()} == {"b": "Europe/Berlin", "n": "America/New_York", "l": "Australia/Lord_Howe"}
    many = T.estimate_zones(samples, ["UTC"] * 600 + ["Europe/Berlin"])  # no number of candidates is too large
    assert {r.place: r.zone for r in many.where("place = 'b'").collect()} == {"b": "Europe/Berlin"}


def test_zone_names_stand_for_all(spark):
    names = T.zone_names(spark)
    assert 100 < len(names) == len(set(names)) and len({"Europe/Berlin", "Europe/Paris", "Europe/Amsterdam"} & set(names)) <= 1
    offsets = {tuple(ZoneInfo(z).utcoffset(dt.datetime(2019, m, 15)).total_seconds() / 3600 for m in (1, 7)) for z in names}
    assert {(0, 0), (5.5, 5.5), (1, 2), (-5, -4), (11, 10.5)} <= offsets


def test_history_with_a_change_and_hidden_zones(spark):
    """Zones nobody declares, out of all there are: one with a change in June 2018, one without, one known by sequence alone, one with too little evidence of a change."""
    rows, k = [], 0
    zone_of = {"moved": lambda t: "Europe/Berlin" if t < dt.datetime(2018, 6, 1) else "America/New_York", "stayed": lambda t: "Asia/Kathmandu", "sequence": lambda t: "Australia/Adelaide", "glitch": lambda t: "Europe/Lisbon"}
    for place, zone in zone_of.items():
        for day in range(0, 720, 5):
            k += 1
            local = dt.datetime(2017, 6, 4, 12) + dt.timedelta(days=day)
            instant = int(local.replace(tzinfo=ZoneInfo(zone(local))).timestamp()) * 1_000_000
            wrong = day % 45 == 0 if place != "glitch" else day > 690
            anchor = None if place == "sequence" else instant + (86_400_000_000 if wrong else 0)
            near = (instant - 1_200_000_000, instant + 1_200_000_000) if place == "sequence" else (None, None)
            rows.append((place, int(local.replace(tzinfo=UTC).timestamp()) * 1_000_000, anchor, None, *near))
    rows += [("none", 1, None, None, None, None), ("none", None, 5, None, None, None)]
    samples = spark.createDataFrame(rows, "place string, local_us long, anchor_us long, ingested_us long, after_us long, before_us long")
    got = {}
    for r in T.estimate_history(samples).collect():
        offsets = tuple(ZoneInfo(r.zone).utcoffset(dt.datetime(2019, m, 15)).total_seconds() / 3600 for m in (1, 7))
        got.setdefault(r.place, []).append((r.since_us, r.until_us, offsets))
    june = int(dt.datetime(2018, 6, 1, tzinfo=UTC).timestamp()) * 1_000_000
    assert sorted(got["moved"], key=lambda x: x[0] or 0) == [(None, june, (1, 2)), (june, None, (-5, -4))]
    assert got["stayed"] == [(None, None, (5.75, 5.75))] and got["sequence"] == [(None, None, (10.5, 9.5))] and got["glitch"] == [(None, None, (0, 1))]
    assert set(got) == set(zone_of)
    assert T.estimate_history(samples.limit(0)).count() == 0


def test_neighbours_in_sequence(spark):
    rows = [("a", 1, None), ("a", 2, 50), ("a", 3, None), ("a", 4, 70), ("a", 5, None), ("b", 3, None), ("a", 1500, None)]
    got = {(r.place, r.n): (r.after_us, r.before_us) for r in T.in_sequence(spark.createDataFrame(rows, "place string, n long, known_us long"), "n").collect()}
    assert got == {("a", 1): (None, 50), ("a", 2): (None, 70), ("a", 3): (50, 70), ("a", 4): (50, None), ("a", 5): (70, None), ("b", 3): (None, None), ("a", 1500): (None, None)}


def test_instants_of_a_library_without_zone(spark, tiny, tmp_path):
    """With one library's zone hidden, the estimated history gives the same instants as the declared zone did."""
    from pathlib import Path

    found = {r.file_id: r.epoch_ms for r in T.capture_instants(spark, tiny).collect()}
    most = T.zone_samples(T.evidence(spark, tiny)).where("anchor_us IS NOT NULL").groupBy("place").count().orderBy(F.desc("count"), "place").first().place
    for p in Path(tiny).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        if p.stem == "libraries":
            df = df.withColumn("home_zone", F.when(F.col("library_id") == most, "unknown").otherwise(F.col("home_zone")))
        df.write.parquet(str(tmp_path / p.name))
    again = {r.file_id: r.epoch_ms for r in T.capture_instants(spark, str(tmp_path)).collect()}
    differ = [k for k in found.keys() | again.keys() if found.get(k) != again.get(k)]
    print("differ", len(differ), "of", len(found))
    assert len(differ) <= 0.02 * len(found)


def test_found_against_python(spark, tiny):
    """p3_found against a reading of the same rules in plain Python."""
    read = lambda n: [r.asDict() for r in spark.read.parquet(f"{tiny}/{n}.parquet").collect()]
    files, exif, places = {}, {}, read("libraries")
    for r in sorted(read("files"), key=lambda r: r["last_seen_at"]):
        files[r["id"]] = r
    for r in read("exif"):
        exif[r["file_id"]] = r
    months = {m: k + 1 for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}

    def offset(t):
        t = re.sub(r"\s", "", t or "").replace("−", "-")
        if t in ("Z", "UTC", "GMT"):
            return 0
        m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d):?(\d\d)?", t)
        if not m:
            return None
        n = int(m[2]) * 60 + int(m[3] or 0)
        return None if n > 840 or int(m[3] or 0) > 59 else n * (1 if m[1] == "+" else -1)

    def parse(t):
        t = (t or "").strip()
        zone = re.search(r"\s*(Z|GMT|UTC|[+-]\d\d:?\d\d)$", t) if not re.fullmatch(r"[\d: /.-]+", t) or re.search(r"[+-]\d\d:\d\d$", t) else None
        body, tz = (t[: zone.start()], zone[1]) if zone else (t, None)
        body = re.sub(r"\s+", " ", body.replace(",", ".") if re.match(r"\d{4}:", body) else body)
        for f in ("%Y:%m:%d %H:%M:%S", "%Y:%m:%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%a, %d %b %Y %H:%M:%S", "%b %d, %Y %I:%M:%S %p", "%m/%d/%Y %I:%M:%S %p", "%d/%m/%Y %I:%M:%S %p", "%d.%m.%Y %H:%M"):
            try:
                return dt.datetime.strptime(body, f), tz
            except ValueError:
                pass
        return None, None

    assert months["Dec"] == 12
    good = lambda ms: ms is not None and T.SPAN_MS[0] <= ms < T.SPAN_MS[1]
    expected = {}
    for k, f in files.items():
        e, ms = exif.get(k, {}), None
        raw = (e.get("datetime_original_raw") or "").strip()
        if re.fullmatch(r"\d{10}|\d{13}", raw):
            ms = int(raw) * (1000 if len(raw) == 10 else 1)
        else:
            local, tz = parse(raw)
            if local:
                minutes = offset(tz) if offset(tz) is not None else offset(e.get("timezone_offset"))
                home = max((p for p in places if f["path"].startswith(p["root"] + "/")), key=lambda p: len(p["root"]), default=None)
                zone = dt.timezone(dt.timedelta(minutes=minutes)) if minutes is not None else ZoneInfo(home["home_zone"])
                at = local.replace(tzinfo=zone).astimezone(UTC) - dt.datetime(1970, 1, 1, tzinfo=UTC)
                ms = at // dt.timedelta(milliseconds=1)
        if not good(ms):
            x = f["exif_dt"]
            ms = next((m for m in (int(x * 1000), int(x)) if good(m)), None) if x is not None else None
        if ms is not None:
            expected[k] = ms
    got = {r.file_id: r.epoch_ms for r in T.capture_instants(spark, tiny).collect()}
    assert got == expected
