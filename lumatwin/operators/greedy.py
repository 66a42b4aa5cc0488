"""Greedy groups by size and hash without a list of all similar pairs: a third of all files may be similar to each other.

Sizes are cut into bins of the logarithm, so that all sizes of one bin are similar and similar ones are at most two bins apart. Leaders of
one hash are never similar in size, so a bin holds at most one of them, and there are a few hundred bins at most.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatwin.functions.media import size_ratio
from lumatwin.operators.hamming import near_digits
from lumatwin.stage import Stage

#: Keys beside bins, which are 0 at least: every cell of a hash, and the one without a size.
_ALL, _UNSIZED = -10, -11


def size_bin(size: Column, ratio: float) -> Column:
    """Number of the bin of a size, null without one. Bins are a little narrower than the ratio, against rounding."""
    return F.floor(F.log(size) / F.lit(-math.log(1 - ratio) * (1 - 1e-6)))


def _first_by_size(items: DataFrame, leaders: DataFrame, ratio: float) -> DataFrame:
    """(id, leader): the smallest leader whose size doesn't differ from the item's by more than ratio, where both have one.

    Of the leaders of a bin only those count that no nearer one with a smaller id stands before, seen from either side.
    """
    sizes = leaders.where("size IS NOT NULL").groupBy("bin", "size").agg(F.min("id").alias("leader"))
    before = lambda order: F.min("leader").over(Window.partitionBy("bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    steps = []
    for order, offsets in ((F.desc("size"), (0, 1, 2)), (F.asc("size"), (-1, -2))):
        kept = sizes.withColumn("_b", before(order)).where("_b IS NULL OR leader < _b")
        steps.append(kept.select(F.explode(F.array(*[F.col("bin") + k for k in offsets])).alias("bin"), F.col("size").alias("other"), "leader"))
    sized = items.join(steps[0].union(steps[1]), "bin").where(size_ratio(F.col("size"), F.col("other")) <= ratio).select("id", "leader")
    rest = leaders.agg(F.min("id").alias("all"), F.min(F.when(F.col("size").isNull(), F.col("id"))).alias("unsized"))
    free = items.join(F.broadcast(rest)).select("id", F.when(F.col("size").isNull(), F.col("all")).otherwise(F.col("unsized")).alias("leader"))  # one row
    return sized.union(free.where("leader IS NOT NULL"))


def _first(items: DataFrame, leaders: DataFrame, pairs: DataFrame | None, ratio: float) -> DataFrame:
    """(id, leader): the smallest similar leader of each item that has one."""
    if pairs is None:
        parts = [_first_by_size(items, leaders, ratio)]
    else:
        near = leaders.join(pairs, "v").select(F.col("w").alias("v"), F.col("size").alias("other"), F.col("id").alias("leader"))
        fits = F.coalesce(size_ratio(F.col("size"), F.col("other")) <= ratio, F.lit(True))
        parts = [
            _first_by_size(items.where("v IS NULL"), leaders, ratio), _first_by_size(items.where("v IS NOT NULL"), leaders.where("v IS NULL"), ratio),
            items.join(near, "v").where(fits).select("id", "leader"),
        ]
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.min("leader").alias("leader"))


def _next_leaders(spark: SparkSession, cells: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The items of cells(v, bin, id, size), the first of each hash and bin, that are smaller than those of all cells that could be similar."""
    # a few hundred rows: smallest ids by bin, of items without a hash and of all
    least = cells.groupBy("bin").agg(F.min(F.when(F.col("v").isNull(), F.col("id"))).alias("plain"), F.min("id").alias("all")).collect()
    limits = []
    for row in least:
        around = [r for r in least if None in (r.bin, row.bin) or abs(r.bin - row.bin) <= 2]
        limits.append((-1 if row.bin is None else row.bin, min((r.plain for r in around if r.plain is not None), default=None), min(r["all"] for r in around)))
    limit = spark.createDataFrame(limits, "b long, plain long, all long")
    open_ = cells.join(F.broadcast(limit), F.coalesce("bin", F.lit(-1)) == F.col("b"))  # a few hundred rows
    plain = open_.where("v IS NULL AND id <= all").select(*cells.columns)
    if pairs is None:
        return plain
    hashed = open_.where("v IS NOT NULL AND (plain IS NULL OR id <= plain)").select(*cells.columns)
    serves = F.when(F.col("bin").isNull(), F.array(F.lit(_ALL), F.lit(_UNSIZED))).otherwise(F.array(F.lit(_ALL), *[F.col("bin") + k for k in range(-2, 3)]))
    reach = cells.join(pairs, "v").select(F.col("w").alias("v"), F.explode(serves.cast("array<long>")).alias("key"), "id").groupBy("v", "key").agg(F.min("id").alias("limit"))
    asks = F.when(F.col("bin").isNull(), F.array(F.lit(_ALL))).otherwise(F.array(F.col("bin"), F.lit(_UNSIZED)))
    beaten = hashed.select("id", "v", F.explode(asks.cast("array<long>")).alias("key")).join(reach, ["v", "key"]).where(F.col("limit") < F.col("id")).select("id").distinct()
    return plain.union(hashed.join(beaten, "id", "left_anti").select(*cells.columns))


def similar_groups(spark: SparkSession, items: DataFrame, ratio: float, most: int | None = None) -> DataFrame:
    """(leader, id): greedy groups as by going through items(id, size[, value]) by id, each free one taking all free ones similar to it.

    Two items are similar unless their sizes, where both have one above 0, differ by more than ratio of the larger, or their values, hashes
    of 16 hexadecimal digits as numbers, in more than ``most`` digits where both have one. Each round makes leaders of all free
    items smaller than every free one that could be similar. Groups of one are dropped; a leader is a row of its own group.
    """
    stage = Stage(spark, "greedy")
    value = F.lit(None).cast("long") if most is None else F.col("value")
    rows = items.select("id", F.when(F.col("size") > 0, F.col("size")).alias("size"), value.alias("v"))
    rows = stage.write(rows.withColumn("bin", size_bin(F.col("size"), ratio)), "rows")
    pairs = None
    if most is not None:
        near = near_digits(rows.select(F.col("v").alias("value")), most)
        same = rows.where("v IS NOT NULL").select("v", F.col("v").alias("w")).distinct()
        pairs = stage.write(near.select(F.col("a").alias("v"), F.col("b").alias("w")).union(near.select("b", "a")).union(same), "pairs")
    # of equal items only the first can lead, and what takes one takes all
    left, taken = stage.write(rows.groupBy("v", "bin", "size").agg(F.min("id").alias("id")), "left"), []
    while not left.isEmpty():
        cells = stage.write(left.groupBy("v", "bin").agg(F.min(F.struct("id", "size")).alias("m")).select("v", "bin", "m.id", "m.size"), "cells")
        leaders = stage.write(_next_leaders(spark, cells, pairs), "leaders")
        taken.append(leaders)
        # a leader is similar to itself
        after = stage.write(left.join(_first(left, leaders, pairs, ratio), "id", "left_anti").select(*left.columns), "left")
        stage.drop(cells, left)
        left = after
    if not taken:
        return rows.select(F.col("id").alias("leader"), "id")
    leaders = stage.write(reduce(DataFrame.union, taken), "all")
    stage.drop(*taken)
    members = stage.write(_first(rows.join(leaders.select("id"), "id", "left_anti"), leaders, pairs, ratio), "members")
    return members.select("leader", "id").union(members.select("leader", F.col("leader").alias("id")).distinct())
