"""Every registered query equals its oracle SQL on the smallest test tables."""

from __future__ import annotations

import os

import pytest
from conftest import SMALL

from checkset import oracle, registry
from checkset.compare import oracle_connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


@pytest.fixture(scope="module")
def portfolio(spark):
    return registry.portfolio(spark, SMALL)


def test_each_query_has_an_oracle():
    assert set(registry.QUERIES) == set(oracle.statements())


@pytest.mark.parametrize("name", registry.RELATIONS)
def test_query(connection, portfolio, name):
    result = registry.portable(registry.RELATIONS[name](portfolio))
    cursor = connection.execute(oracle.statements()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert rows(result.columns, [tuple(r) for r in result.collect()]) == rows(
        names, cursor.fetchall()
    )


@pytest.mark.parametrize("name", sorted(oracle.sequences()))
def test_order(connection, portfolio, name):
    ours = [row.account_id for row in registry.RELATIONS[name](portfolio).collect()]
    theirs = [row[0] for row in connection.execute(oracle.sequences()[name]).fetchall()]
    assert ours == theirs
