"""One surviving record per group of duplicates, by votes of its members on each field.

Fields are unpivoted to long rows (group, field, value, source). A row votes for its normalised value with the trust in its source
times a decay with its age; the votes of one value are summed and the value with most votes wins. Winners are pivoted
back to one record per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatwin.operators.ordered import running
from lumatwin.tables import current_files, table

#: [2010-01-01, 2026-01-01) UTC in seconds.
SPAN_S = (1_262_304_000, 1_767_225_600)


def unpivot(rows: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """One row for each field of each row that has a value there: the columns of keep, field_name and value (as text)."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("value")) for n, c in fields.items()])
    return rows.select(*keep, F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("_p")).select(*keep, "_p.*")


def positions(rows: DataFrame, group: str, order: str, field: str = "field_name") -> DataFrame:
    """rows with ``age``: how many rows of the group and field stand before it in the order, for all of them.

    Rows are numbered over the whole table, by ranges of (group, field, order), so a group with most of them is many tasks.
    """
    placed = running(rows, [F.col(group), F.col(field), F.col(order)]).drop("before")
    first = placed.groupBy(group, field).agg(F.min("place").alias("_first"))
    return placed.join(first, [group, field]).withColumn("age", F.col("place") - F.col("_first")).select(*rows.columns, "age")


def normalised(value: Column) -> Column:
    """A value as it's compared: without outer blanks and case; numbers without signs of their form (1e3, 1000.0 and 1000 are equal), cut to whole ones."""
    text = F.lower(F.trim(value))
    number = F.when(text.rlike(r"^[+-]?[0-9]+([.][0-9]*)?(e[+-]?[0-9]{1,2})?$"), F.floor(text.try_cast("double")).cast("long"))
    return F.coalesce(number.cast("string"), text)


def vote(rows: DataFrame, group: str, source: str, trust: Column, age: Column, half_life: float) -> DataFrame:
    """(group, field_name, value, source, votes): the winning value of each field and the youngest source that has it.

    rows(group, field_name, value, source, ...). Votes are trust x 2^(-age / half_life), summed per value to nine decimals; a tie goes to the
    value with the youngest source, then to the smaller source. Null values don't vote. Values are compared as they stand: see normalised().
    """
    weight = (trust * F.pow(F.lit(2.0), -age / F.lit(half_life))).alias("_w")
    cast = rows.where("value IS NOT NULL").select(group, "field_name", "value", F.col(source).alias("_source"), age.cast("double").alias("_age"), weight)
    sums = cast.groupBy(group, "field_name", "value").agg(F.round(F.sum("_w"), 9).alias("votes"), F.min(F.struct("_age", "_source")).alias("_first"))
    rank = F.struct("votes", -F.col("_first._age"), -F.col("_first._source"))
    best = sums.groupBy(group, "field_name").agg(F.max_by(F.struct("value", F.col("_first._source").alias("source"), "votes"), rank).alias("_b"))
    return best.select(group, "field_name", "_b.value", F.col("_b.source").alias(source), "_b.votes")


def _between(c: Column, low: float, high: float) -> Column:
    """c where it lies in [low, high), else null; NaN is null."""
    return F.when(~F.isnan(c.cast("double")) & (c >= low) & (c < high), c)


def group_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, file_id, field_name, value, precedence): the usable values of the members of groups that count.

    Groups count with a dup_groups row and at least two different members in files. precedence sorts the members of a
    group: more usable values, then dims_w (larger), exif_dt (earlier), size (larger), mtime (later), then file_id; unusable last.
    """
    groups = table(spark, sf_dir, "dup_groups").select(F.col("id").alias("group_id")).where("group_id IS NOT NULL").distinct()
    members = table(spark, sf_dir, "group_members").select("group_id", "file_id").where("group_id IS NOT NULL AND file_id IS NOT NULL").distinct()
    files = current_files(spark, sf_dir, ["id", "last_seen_at", "size", "dims_w", "exif_dt", "mtime"]).withColumnRenamed("id", "file_id")
    usable = {
        "size": F.when(F.col("size") >= 1, F.col("size")),
        "dims_w": F.when(F.col("dims_w").between(1, 100_000), F.col("dims_w")),
        "exif_dt": _between(F.col("exif_dt"), *SPAN_S),
        "mtime": _between(F.col("mtime"), *SPAN_S),
    }
    known = files.select("file_id", *[c.alias(n) for n, c in usable.items()])
    rows = members.join(groups, "group_id", "left_semi").join(known, "file_id")
    two = rows.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    count = sum((F.col(n).isNotNull().cast("int") for n in usable), F.lit(0))
    late = lambda c, sign: F.coalesce(sign * c, F.lit(float("inf")))
    order = F.struct(
        (-count).alias("n"), late(F.col("dims_w").cast("double"), -1).alias("w"), late(F.col("exif_dt"), 1).alias("e"),
        late(F.col("size").cast("double"), -1).alias("s"), late(F.col("mtime"), -1).alias("m"), F.col("file_id"),
    )
    rows = rows.join(two, "group_id", "left_semi").withColumn("precedence", order)
    return unpivot(rows, ["group_id", "file_id", "precedence"], {"record": F.col("file_id"), **{n: F.col(n) for n in usable}})


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each member's vote decays by half with every place it stands behind in precedence, so the first usable value outweighs all others together."""
    aged = positions(group_fields(spark, sf_dir), "group_id", "precedence")
    return vote(aged, "group_id", "file_id", F.lit(1.0), F.col("age"), 1.0)


def survivor_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, field_name, file_id): the best file of each group and the file that supplies each field; no row where none does."""
    return _winners(spark, sf_dir).select("group_id", "field_name", "file_id")


def survivor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners pivoted back: one record per group with its best file and the winning values."""
    wide = _winners(spark, sf_dir).groupBy("group_id").pivot("field_name", ["record", "size", "dims_w", "exif_dt", "mtime"]).agg(F.first("value"))
    return wide.select("group_id", F.col("record").cast("long").alias("file_id"), F.col("size").cast("long"), F.col("dims_w").cast("int"), F.col("exif_dt").cast("double"), F.col("mtime").cast("double"))


def survivor_consensus(spark: SparkSession, sf_dir: str, half_life_days: float = 180.0) -> DataFrame:
    """The same fields by real votes: members that were seen later count more, complete ones are trusted more.

    Trust is the number of usable values; age is how long before the last member of its group a file was last seen. Times that are equal to the second agree.
    """
    rows = group_fields(spark, sf_dir).where("field_name <> 'record'")
    seen = table(spark, sf_dir, "files").groupBy(F.col("id").alias("file_id")).agg(F.max("last_seen_at").alias("seen"))
    rows = rows.join(seen, "file_id")
    last = rows.groupBy("group_id").agg(F.max("seen").alias("last"))
    age = (F.col("last") - F.col("seen")) / 86_400.0
    rows = rows.join(last, "group_id").withColumn("value", normalised(F.col("value")))
    return vote(rows, "group_id", "file_id", -F.col("precedence.n"), age, half_life_days).select("group_id", "field_name", "value", "file_id")
