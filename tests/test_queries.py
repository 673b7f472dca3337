"""Every catalogue query against its SQL on the smallest tables; the rest for rows."""

from __future__ import annotations

import pytest

from galena.plans import catalog_queries as Q
from tests.oracle import compare

#: Queries whose filters leave nothing on the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, small, name):
    rows, unlike = compare(Q.QUERIES[name](spark, small), Q.ORACLES[name], small)
    assert not unlike
    assert rows > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_has_rows(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
