"""The queries p1 to p8 against their SQL, and on odd tables."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from compare import check, duck

from lumatwin.llm import queries as Q

NAMES = ["p1_found", "p2_found", "p2_similar_embeddings", "p4_found", "p4_records", "p4_consensus", "p5_found"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, tiny, name):
    check(Q.queries()[name](spark, tiny), duck(tiny), Q.oracle_sql()[name])


@pytest.fixture(scope="module")
def odd(spark, tiny, tmp_path_factory):
    """The smallest tables, each row twice, with rows of nulls and further columns whose names operators use inside."""
    from pyspark.sql import functions as F

    to = tmp_path_factory.mktemp("odd")
    for p in Path(tiny).glob("*.parquet"):
        df = spark.read.parquet(str(p))
        if p.stem in ("documents", "people", "libraries", "mix_targets"):
            more = df  # ids are unique there
        else:
            more = df.union(df).union(df.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))
        for c in ("ids", "value", "window", "u", "v", "vertex", "root_", "cls", "tokens", "chunk", "age", "votes", "p", "a", "b", "kind", "place"):
            if c not in more.columns:
                more = more.withColumn(c, F.lit("x"))
        more.write.parquet(str(to / p.name))
    return str(to)


@pytest.mark.parametrize("name", [*Q.queries()])
def test_repeated_null_and_further_columns(spark, tiny, odd, name):
    rows = lambda d: sorted(map(str, Q.queries()[name](spark, d).collect()))
    assert rows(odd) == rows(tiny)


@pytest.fixture(scope="module")
def empty(spark, tiny, tmp_path_factory):
    to = tmp_path_factory.mktemp("empty")
    for p in Path(tiny).glob("*.parquet"):
        spark.read.parquet(str(p)).limit(0).write.parquet(str(to / p.name))
    yield str(to)
    shutil.rmtree(to)


@pytest.mark.parametrize("name", [*Q.queries()])
def test_empty_tables(spark, empty, name):
    assert Q.queries()[name](spark, empty).where("tokens > 0" if name == "p7_shares" else "true").count() == 0
