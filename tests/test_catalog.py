"""Every catalogued query against its reference SQL."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from tallywright.catalog.queries import QUERIES

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(small):
    con = connect(small)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, small, engine, name):
    assert differences(QUERIES[name](spark, small), engine, ORACLES[name]) == []


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns[:3] == ["unit", "pnl_group", "concept"]
    assert frame.count() > 0
