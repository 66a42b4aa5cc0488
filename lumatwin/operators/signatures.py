"""Signatures of sets of descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, key: str, descriptor: str) -> DataFrame:
    """(key, signature): the mean of each dimension, then its deviation, over all descriptors of a key, each cut to a byte 0 to 255, as hexadecimal text.

    Descriptors may differ in length: a dimension counts those that have it. Null descriptors and values don't count; a key with none has no
    row. Descriptors are taken apart and summed where they lie, so a key with most of them is no hot task.
    """
    flat = rows.select(key, F.posexplode(descriptor).alias("_d", "_v")).where("_v IS NOT NULL")
    byte = lambda c: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c))).cast("long")), 2, "0")
    each = flat.groupBy(key, "_d").agg(byte(F.avg("_v")).alias("m"), byte(F.stddev_pop("_v")).alias("s"))
    wide = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_d", "m", "s"))).alias("l"))
    return wide.select(key, F.lower(F.concat(F.array_join(F.transform("l", lambda x: x["m"]), ""), F.array_join(F.transform("l", lambda x: x["s"]), ""))).alias("signature"))
