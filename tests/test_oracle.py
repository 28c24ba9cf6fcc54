"""Every registered query against its SQL on a second engine."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_points
from siftframe.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    assert difference(QUERIES[name](spark, folder), duck, ORACLES[name]) is None


def test_flagship_query(spark):
    rows = entry_points.entry(spark).collect()
    assert 0 < len(rows) <= 10
    values = [r["value"] for r in rows]
    assert values == sorted(values, reverse=True)
