"""Every raster query that SQL can express gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest
from conftest import same_rows

from rastra.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, duck):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "p"]
