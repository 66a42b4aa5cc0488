"""Timestamps of mixed formats, precisions and zones as UTC instants.

Texts are rewritten to nine parts by one regular expression per family of formats; the zone comes from the text, else from
a separate offset text, else from the place the record belongs to. Where a place has no usable zone, its offset history is
estimated: each candidate history, of one zone or of two with a change between them, is tried on the place's unzoned local times, and the
one with the fewest violations (instants off a known anchor time, after ingestion, or out of sequence) is taken. Everything is a column expression or a grouped
aggregation with a partial step, so nothing runs row by row in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatwin.operators.bounded import small
from lumatwin.stage import Stage
from lumatwin.tables import current_files, table

_ZONE = r"(Z|z|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|UTC|GMT)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp]\.?[Mm]\.?)?\s*" + _ZONE
_NUMERIC = r"^(\d{4})[:/.\-](\d{1,2})[:/.\-](\d{1,2})[Tt ,]\s*" + _CLOCK + "$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?\s*" + _ZONE + "$"
_DAY_NAME_FIRST = r"^(?:[A-Za-z]{3,9}\.?,?\s+)?(\d{1,2})\.?\s+([A-Za-z]{3})[a-z]{0,6}\.?,?\s+(\d{4}),?\s+" + _CLOCK + "$"
_MONTH_NAME_FIRST = r"^(?:[A-Za-z]{3,9}\.?,\s+)?([A-Za-z]{3})[a-z]{0,6}\.?\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _CLOCK + "$"
_YEAR_LAST = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}),?\s+" + _CLOCK + "$"
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

#: The span in which an instant is believed, in milliseconds: [2010-01-01, 2026-01-01) UTC.
SPAN_MS = (1_262_304_000_000, 1_767_225_600_000)
_FARTHEST_MIN = 14 * 60


def offset_minutes(text: Column) -> Column:
    """An offset text (+05:30, -0400, +02, Z, UTC+01:00, blanks and the minus sign allowed) in minutes; null if it is none or beyond 14 hours."""
    return _let(F.translate(F.upper(F.regexp_replace(text, r"\s+", "")), "−", "-"), _offset)


def _offset(t: Column) -> Column:
    shape = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    part = lambda k: F.regexp_extract(t, shape, k).try_cast("int")
    rest = F.coalesce(part(3), F.lit(0))
    minutes = part(2) * 60 + rest
    signed = F.when(F.regexp_extract(t, shape, 1) == "-", -minutes).otherwise(minutes)
    return F.when(t.isin("Z", "UTC", "GMT"), 0).when(t.rlike(shape) & (minutes <= _FARTHEST_MIN) & (rest < 60), signed)


def _month(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.initcap(name))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once: a lambda's argument isn't written out again by the optimizer."""
    return F.transform(F.array(value), then)[0]


def _read(t: Column) -> Column:
    """A cleaned text as struct(local_us, zone_text, epoch_ms)."""
    cut = lambda pattern, to: F.when(t.rlike(pattern), F.split(F.regexp_replace(t, pattern, to), r"\|"))
    parts = F.coalesce(
        cut(_NUMERIC, "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
        cut(_COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8|"),
        cut(_DAY_NAME_FIRST, "$3|$2|$1|$4|$5|$6|$7|$8|$9|n"),
        cut(_MONTH_NAME_FIRST, "$3|$1|$2|$4|$5|$6|$7|$8|$9|n"),
        F.when(t.rlike(r"^\d{1,2}\."), cut(_YEAR_LAST, "$3|$2|$1|$4|$5|$6|$7|$8|$9|y")).otherwise(cut(_YEAR_LAST, "$3|$1|$2|$4|$5|$6|$7|$8|$9|y")),
    )
    epoch = F.when(t.rlike(r"^\d{10}$"), t.try_cast("long") * 1000).when(t.rlike(r"^\d{13}$"), t.try_cast("long"))
    return _let(parts, lambda p: F.struct(_wall_clock(p).alias("local_us"), p[8].alias("zone_text"), epoch.alias("epoch_ms")))


def _wall_clock(p: Column) -> Column:
    """Parts (year, month, day, hour, minute, second, fraction, half of day, zone, kind) as microseconds, null if not a real time."""
    num = lambda k: p[k].try_cast("int")
    first = F.when(p[9] == "n", _month(p[1])).otherwise(p[1]).try_cast("int")
    swap = (p[9] == "y") & (first > 12)
    month, day = F.when(swap, num(2)).otherwise(first), F.when(swap, first).otherwise(num(2))
    half = F.lower(F.substring(p[7], 1, 1))
    hour = F.when(half == "", num(3)).when(num(3).between(1, 12), num(3) % 12 + F.when(half == "p", 12).otherwise(0))
    second = F.when(p[5] == "", 0).otherwise(num(5))
    micros = F.when(p[6] == "", 0).otherwise(F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("int"))
    real = (hour < 24) & (num(4) < 60) & (second < 60) & (num(0) > 0)
    date = F.when(real, F.try_to_date(F.format_string("%04d-%02d-%02d", num(0), month, day), "yyyy-MM-dd"))
    return (F.unix_date(date).cast("long") * 86_400 + hour * 3600 + num(4) * 60 + second) * 1_000_000 + micros


def with_local(df: DataFrame, text: str) -> DataFrame:
    """df with the columns local_us, zone_text and epoch_ms parsed from a text column.

    local_us: the wall clock read as if it were UTC, in microseconds; zone_text: the zone written in the text, or empty;
    epoch_ms: set instead for texts of 10 or 13 digits. All are null where the text names no real date and time. Missing
    seconds are 0. Of a day and month in either order the one above 12 is the day; if both fit, the day stands first
    after dots and the month after slashes.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"^[\s\x00\xa0]+|[\s\x00\xa0]+$", ""), r"\s+", " ")
    return df.withColumn("_read", _let(clean, _read)).select(*df.columns, "_read.*")


def local_to_utc_us(local_us: Column, zone: Column) -> Column:
    """Wall-clock microseconds in a named zone as UTC microseconds.

    A time that occurs twice is its first occurrence; a skipped one is read with the offset before the change.
    """
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def owners(files: DataFrame, places: DataFrame) -> DataFrame:
    """files(file_id, path) with the row of places(root, ...) whose root is the longest whole leading directory of the path.

    Each path is joined under all its leading directories, so the cost doesn't depend on the number of places. Files
    under no root keep nulls.
    """
    rest = [c for c in places.columns if c != "root"]
    roots = places.where(F.col("root").isNotNull()).withColumn("_dir", F.regexp_replace("root", "/+$", "")).groupBy("_dir").agg(F.max(F.struct(*rest)).alias("_place"))
    steps = F.split(F.col("path"), "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    found = files.select("file_id", F.explode_outer(dirs).alias("_dir")).join(small(roots), "_dir")
    best = found.groupBy("file_id").agg(F.max(F.struct(F.length("_dir").alias("n"), F.col("_place"))).alias("_best"))
    return files.join(best, "file_id", "left").select(*files.columns, *[F.col("_best._place")[c].alias(c) for c in rest])


def us_to_ms(us: Column) -> Column:
    """Microseconds as whole milliseconds, fractions cut off towards the past."""
    return F.floor((us - F.pmod(us, F.lit(1000).cast("long"))) / 1000).cast("long")


def known_zone(zone: Column) -> Column:
    """A zone name that the JVM may read: Area/Place or UTC; others are null."""
    return F.when(zone.rlike(r"^(UTC|[A-Z][A-Za-z]+(/[A-Z][A-Za-z_\-]+)+)$"), zone)


def _tried(samples: DataFrame, candidates: list[str], tolerance_s: int) -> DataFrame:
    """(place, _c(k, zone), _month, violated) of each sample and candidate. Samples without any evidence are left out."""
    known = [c for c in ("anchor_us", "ingested_us", "after_us", "before_us") if c in samples.columns]
    some = F.coalesce(*[F.col(c) for c in known]).isNotNull()
    tries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(z).alias("zone")) for k, z in enumerate(candidates)])
    rows = samples.where(F.col("local_us").isNotNull() & some).withColumn("_c", F.explode(tries))
    instant, slack = local_to_utc_us(F.col("local_us"), F.col("_c.zone")), tolerance_s * 1_000_000
    broken = {
        "anchor_us": lambda c: F.abs(instant - c) > slack, "ingested_us": lambda c: instant > c + slack, "after_us": lambda c: instant < c - slack, "before_us": lambda c: instant > c + slack,
    }
    violated = F.lit(False)
    for c in known:
        violated = violated | F.coalesce(broken[c](F.col(c)), F.lit(False))
    month = F.trunc(F.timestamp_micros("local_us").cast("date"), "month")
    return rows.select("place", "_c", month.alias("_month"), violated.cast("long").alias("violated"))


def estimate_zones(samples: DataFrame, candidates: list[str], tolerance_s: int = 90) -> DataFrame:
    """(place, zone, violations, samples): for each place the zone with the fewest violations.

    samples(place, local_us, anchor_us?, ingested_us?, after_us?, before_us?): wall clocks without a zone, and what is known besides: an
    independent instant, the time after which the record can't have been made, and instants of earlier and later records in
    sequence (see in_sequence). A candidate is violated by a sample if it puts the instant more than tolerance_s from the anchor or beyond one of
    the bounds. Samples with none of these are no evidence. Ties go to the candidate that comes first. Counts are summed per place and
    candidate before the shuffle, so a place with a third of all rows is no hot key.
    """
    sums = _tried(samples, candidates, tolerance_s).groupBy("place", "_c").agg(F.sum("violated").alias("violations"), F.count("*").alias("samples"))
    best = sums.groupBy("place").agg(F.min(F.struct("violations", F.col("_c.k").alias("k"), F.col("_c.zone").alias("zone"), "samples")).alias("b"))
    return best.select("place", "b.zone", "b.violations", "b.samples")


def zone_names(spark: SparkSession, years: tuple[int, int] = (2010, 2026)) -> list[str]:
    """Names of zones, Area/Place and UTC, that the JVM knows: of those whose offsets are the same on every day of the years only the first by name."""
    ids = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    names = sorted(z for z in map(str, ids) if z == "UTC" or ("/" in z and not z.startswith(("Etc/", "SystemV/", "US/"))))
    zones = spark.createDataFrame([(z,) for z in names], "zone string").repartition(spark.sparkContext.defaultParallelism)
    days = F.explode(F.sequence(F.lit(f"{years[0]}-01-01").cast("date"), F.lit(f"{years[1]}-01-01").cast("date"))).alias("day")
    noon = F.unix_date("day").cast("long") * 86_400_000_000 + 43_200_000_000
    offset = (noon - local_to_utc_us(noon, F.col("zone"))) / 60_000_000
    same = zones.select("zone", days).groupBy("zone").agg(F.sum(F.xxhash64("day", offset).cast("decimal(30,0)")).alias("h"))
    return sorted(r.zone for r in same.groupBy("h").agg(F.min("zone").alias("zone")).collect())  # some hundred names


def estimate_history(samples: DataFrame, candidates: list[str] | None = None, tolerance_s: int = 90, gain: float = 0.02, part: int = 20) -> DataFrame:
    """(place, zone, since_us, until_us, violations, samples): the offset history of each place with the fewest violations.

    samples as for estimate_zones. A history is one zone, or two with a change at the start of a month, if that saves violations in at least the share
    ``gain`` of the samples, and three, and each zone has ``part`` samples: with hundreds of zones to choose from, some fits a few odd samples by chance;
    since_us and until_us bound the wall clocks that a zone holds for (null: no bound). candidates: all zones the JVM knows unless given. Ties go
    to the candidate that comes first and the earliest change. Violations are counted per place, month and zone before anything is shuffled;
    what follows is as large as the places times months times zones, whatever the samples.
    """
    spark = samples.sparkSession
    candidates = zone_names(spark) if candidates is None else candidates
    months = _tried(samples, candidates, tolerance_s).groupBy("place", "_c", "_month").agg(F.sum("violated").alias("v"), F.count("*").alias("n"))
    months = Stage(spark, "zones").write(months.select("place", "_c.k", "_c.zone", "_month", "v", "n"), "months")
    # every zone was tried on the same samples, so it has a row for each month that has some
    up_to = Window.partitionBy("place", "k").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("place", "k")
    sums = months.select("place", "k", "zone", "_month", F.coalesce(F.sum("v").over(up_to), F.lit(0)).alias("before"), F.sum("v").over(all_).alias("total"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("n0"), F.sum("n").over(all_).alias("n"))
    pick = lambda v: F.min(F.struct(v.alias("v"), "k", "zone"))
    cut = sums.groupBy("place", "_month").agg(pick(F.col("before")).alias("old"), pick(F.col("total") - F.col("before")).alias("new"), pick(F.col("total")).alias("one"), F.max("n0").alias("n0"), F.max("n").alias("n"))
    enough = (F.col("n0") >= part) & (F.col("n") - F.col("n0") >= part)
    best = cut.groupBy("place").agg(F.min(F.when(enough, F.struct((F.col("old.v") + F.col("new.v")).alias("v"), "_month", "old", "new", "n0"))).alias("two"), F.min("one").alias("one"), F.max("n").alias("n"))
    at = F.unix_date(F.col("two._month")).cast("long") * 86_400_000_000
    none, long_ = F.lit(None).cast("long"), "long"
    piece = lambda zone, since, until, v, n: F.struct(zone.alias("zone"), since.alias("since_us"), until.alias("until_us"), v.cast(long_).alias("violations"), n.cast(long_).alias("samples"))
    one = F.array(piece(F.col("one.zone"), none, none, F.col("one.v"), F.col("n")))
    two = F.array(piece(F.col("two.old.zone"), none, at, F.col("two.old.v"), F.col("two.n0")), piece(F.col("two.new.zone"), at, none, F.col("two.new.v"), F.col("n") - F.col("two.n0")))
    changed = F.col("two").isNotNull() & (F.col("one.v") - F.col("two.v") >= F.greatest(F.lit(3.0), F.col("n") * gain))
    return best.select("place", F.explode(F.when(changed, two).otherwise(one)).alias("p")).select("place", "p.*")


def in_sequence(rows: DataFrame, order: str, stretch: int = 1000) -> DataFrame:
    """rows(place, known_us?, ...) with after_us and before_us: the latest known instant before a row in its place's order, and the earliest after it.

    Only rows of one stretch of the order (numbers of the column, ``stretch`` at a time) tell of each other: neighbours in sequence are what counts, and
    a place with most rows is many tasks. Rows without such neighbours get nulls.
    """
    key = ["place", F.floor(F.col(order) / stretch)]
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumns({"after_us": F.max("known_us").over(before), "before_us": F.min("known_us").over(after)})


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per current file: its library, what its texts say, and the other times known of it."""
    files = current_files(spark, sf_dir, ["id", "last_seen_at", "path", "exif_dt", "created_at"]).withColumnRenamed("id", "file_id")
    exif = table(spark, sf_dir, "exif").select("file_id", "datetime_original_raw", "timezone_offset").where("file_id IS NOT NULL")
    exif = exif.groupBy("file_id").agg(F.max(F.struct("datetime_original_raw", "timezone_offset")).alias("_e")).select("file_id", "_e.*")
    places = table(spark, sf_dir, "libraries").select("root", "library_id", F.col("home_zone"))
    return with_local(owners(files, places).join(exif, "file_id", "left"), "datetime_original_raw")


def _believed(ms: Column) -> Column:
    return F.when((ms >= SPAN_MS[0]) & (ms < SPAN_MS[1]), ms)


def _stored_ms(value: Column) -> Column:
    """A number that is seconds or milliseconds since 1970, whichever lies in the span."""
    safe = F.when(~F.isnan(value) & (F.abs(value) < 1e15), value)
    return F.coalesce(_believed(F.floor(safe * 1000).cast("long")), _believed(F.floor(safe).cast("long")))


def _candidates(spark: SparkSession, sf_dir: str) -> list[str]:
    """The zones named in libraries, in the order of their names; a zone once, so there are no more than the world has."""
    zones = table(spark, sf_dir, "libraries").select(known_zone(F.col("home_zone")).alias("z")).where("z IS NOT NULL").distinct()
    return sorted(r.z for r in zones.collect())


def zone_samples(seen: DataFrame) -> DataFrame:
    """The unzoned wall clocks of evidence() with stored and ingestion times, by library."""
    bare = F.coalesce(offset_minutes(F.col("zone_text")), offset_minutes(F.col("timezone_offset"))).isNull()
    return seen.where(bare & F.col("library_id").isNotNull()).select(
        F.col("library_id").alias("place"), "local_us", (_stored_ms(F.col("exif_dt")) * 1000).alias("anchor_us"), (F.col("created_at") * 1e6).cast("long").alias("ingested_us")
    )


def zone_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each library the zone its unzoned times fit best, beside the declared one."""
    declared = table(spark, sf_dir, "libraries").select(F.col("library_id").alias("place"), "home_zone").distinct()
    found = estimate_zones(zone_samples(evidence(spark, sf_dir)), _candidates(spark, sf_dir))
    return declared.join(found, "place", "left").select(F.col("place").alias("library_id"), "home_zone", F.col("zone").alias("estimated_zone"), "violations", "samples")


def offset_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each library the offset history its unzoned times fit best, out of all zones there are, whatever it declares: offsets in minutes in winter and summer of each part."""
    found = estimate_history(zone_samples(evidence(spark, sf_dir)))
    at = lambda day: ((F.unix_micros(F.lit(f"{day} 12:00:00Z").cast("timestamp")) - local_to_utc_us(F.unix_micros(F.lit(f"{day} 12:00:00Z").cast("timestamp")), F.col("zone"))) / 60_000_000).cast("int")
    month = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM")
    return found.select(F.col("place").alias("library_id"), month("since_us").alias("since"), "zone", at("2020-01-15").alias("winter_minutes"), at("2020-07-15").alias("summer_minutes"), "violations", "samples")


def capture_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, epoch_ms): the capture instant of each file, where it can be told.

    Null, blank and unreadable texts, impossible dates and instants outside the span fall back to the stored number; files
    without any believable time have no row. Repeated exif rows count once; of different ones the largest text counts.
    """
    seen = evidence(spark, sf_dir)
    without = table(spark, sf_dir, "libraries").where(known_zone(F.col("home_zone")).isNull())
    home = known_zone(F.col("home_zone"))
    if not without.isEmpty():  # places that declare no zone: estimate it
        found = estimate_history(zone_samples(seen.where(home.isNull()))).select(F.col("place").alias("_place"), F.col("zone").alias("_zone"), "since_us", "until_us")
        holds = (F.col("library_id") == F.col("_place")) & (F.col("since_us").isNull() | (F.col("local_us") >= F.col("since_us"))) & (F.col("until_us").isNull() | (F.col("local_us") < F.col("until_us")))
        seen = seen.join(small(found), holds, "left")
        home = F.coalesce(home, F.col("_zone"))
    minutes = F.coalesce(offset_minutes(F.col("zone_text")), offset_minutes(F.col("timezone_offset")))
    us = _let(minutes, lambda m: F.when(m.isNotNull(), F.col("local_us") - m.cast("long") * 60_000_000).otherwise(local_to_utc_us(F.col("local_us"), home)))
    told = F.coalesce(_let(us_to_ms(us), _believed), _believed(F.col("epoch_ms")), _let(F.col("exif_dt"), _stored_ms))
    # exploding instead of filtering: a filter would be pushed below the parse and repeat it
    return seen.select("file_id", F.explode(F.filter(F.array(told), lambda ms: ms.isNotNull())).alias("epoch_ms"))
