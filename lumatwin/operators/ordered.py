"""Row numbers and running sums over a whole table in one order, without a task that sees the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatwin.stage import Stage


#: Rows that one task ranks.
PART = 2_000_000


def running(rows: DataFrame, order: list[Column], total: Column | None = None) -> DataFrame:
    """rows with ``place`` (1 for the first row in the order) and ``before`` (the sum of ``total`` over the rows that come first).

    Rows are range-partitioned by the order and ranked within their partitions; what comes before each partition is a
    window over one row per partition. The order must be total, or ties get places in no fixed order.
    """
    keyed = rows.withColumns({"_order": F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]), "_total": F.coalesce(total, F.lit(0)) if total is not None else F.lit(0)})
    # written once, so that both uses see the same partitions
    stage = Stage(rows.sparkSession, "ordered")
    keyed = stage.write(keyed, "rows")
    n = max(rows.sparkSession.sparkContext.defaultParallelism * 2, -(-keyed.count() // PART))
    parts = stage.write(keyed.repartitionByRange(n, "_order").withColumn("_part", F.spark_partition_id()), "parts")
    stage.drop(keyed)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_total").alias("_s"))
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    own = Window.partitionBy("_part").orderBy("_order")
    rest = own.rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({"_k": F.row_number().over(own), "_b": F.coalesce(F.sum("_total").over(rest), F.lit(0))}).join(F.broadcast(offsets), "_part")
    return out.withColumns({"place": F.col("_k") + F.col("_n0"), "before": F.col("_b") + F.col("_s0")}).select(*rows.columns, "place", "before")


#: Rows of one chunk of an ordered table.
CHUNK = 50_000


def chunked(rows: DataFrame, order: list[Column], halo: int) -> DataFrame:
    """rows with ``place``, ``chunk`` and ``halo``: cut into chunks of CHUNK rows in the order, each with the last ``halo`` rows before it as rows of its own.

    A window that looks back at most ``halo`` rows can then be partitioned by chunk, so a key with most rows isn't one task. Rows with
    halo set only serve others and are to be dropped afterwards.
    """
    placed = running(rows, order).drop("before")
    own = F.floor((F.col("place") - 1) / CHUNK).cast("long")
    late = (F.col("place") - 1) % CHUNK >= CHUNK - halo
    mine, next_ = F.struct(own.alias("chunk"), F.lit(False).alias("halo")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo"))
    return placed.withColumn("_c", F.explode(F.when(late, F.array(mine, next_)).otherwise(F.array(mine)))).select(*rows.columns, "place", "_c.*")
