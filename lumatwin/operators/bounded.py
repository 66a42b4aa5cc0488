"""Broadcasting only what is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """df marked for broadcast if it has at most that many rows, else df as it is: then the join is planned by size."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def sorted_join(a: DataFrame, b: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """a join b, always by sorting: for tables that grow with the input, whatever size Spark takes them for.

    Its estimate is that of the files read. Rows made of them by explode don't count, and ids and roots in order take a few bits each there, so
    it would gather tables of many times spark.sql.autoBroadcastJoinThreshold on the driver.
    """
    return a.join(b.hint("merge"), on, how)
