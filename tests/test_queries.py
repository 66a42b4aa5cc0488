"""Every query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check, duck

from lumatwin.plans import catalog

SQL, QUERIES = catalog.oracle_sql(), catalog.queries()
#: Queries that SQL can't express: tested elsewhere.
WITHOUT_SQL = {"p3_found", "p3_zone_history", "p3_offset_history"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.fixture(scope="module")
def con(tiny):
    return duck(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tiny, con, name):
    check(QUERIES[name](spark, tiny), con, SQL[name])


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0
