"""Every query with SQL against DuckDB over the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

from docspark import queries


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, sf, con):
    assert not differences(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name], con)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
