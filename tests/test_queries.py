"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: query for group in entry.CORE for name, query in group.QUERIES.items()}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLES[name]).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
