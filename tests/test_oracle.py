"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest
from compare import compare, duck
from conftest import SMALL

from stallwise import oracle, registry

QUERIES = registry.queries()
SQL = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql_and_the_reverse():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    same, note = compare(spark, con, QUERIES[name], SQL[name], SMALL)
    assert same, note
