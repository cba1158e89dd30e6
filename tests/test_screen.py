"""Rows screened by key before a wide shuffle: none that a join would find is lost, most others go."""

from __future__ import annotations

from collections import Counter

import pytest

from tallywright.operators import payroll as pay
from tallywright.operators import sales as sa
from tallywright.operators.screen import screened
from tallywright.rules import ORDERS
from tallywright.sources.order_books import load_order_books


@pytest.mark.parametrize("kind", ("bigint", "int", "string"))
def test_screen_keeps_wanted_keys_and_drops_most_others(spark, kind):
    rows = spark.range(20_000).selectExpr(f"cast(nullif(id % 10000, 7) as {kind}) AS k", "id AS v")
    wanted = spark.range(0, 10_000, 20).selectExpr(f"cast(nullif(id, 20) as {kind}) AS k", "id AS w")
    wanted = wanted.union(wanted)
    got = screened(rows, wanted, "k")
    assert got.columns == rows.columns
    assert got.count() < 1100 < rows.count()
    assert Counter(map(tuple, got.join(wanted, "k").collect())) == Counter(map(tuple, rows.join(wanted, "k").collect()))
    assert screened(rows, wanted.limit(0), "k").count() == 0


def test_keys_that_may_hash_apart_are_not_screened(spark):
    rows = spark.sql("SELECT 1 AS k, 0.0D AS d, -0.0D AS e")
    assert screened(rows, spark.sql("SELECT 1L AS k"), "k") is rows
    assert screened(rows, rows.selectExpr("e AS d"), "d") is rows


def test_sales_of_some_units_are_those_of_all_cut_to_them(spark, small):
    books = load_order_books(spark, small)
    for make in (sa.sales_fact, lambda b, r, units=None: sa.sales_monthly(b, r, units=units)):
        want = make(books, ORDERS).filter("unit IN ('A', 'B')")
        assert Counter(map(tuple, make(books, ORDERS, ORDERS.units).collect())) == Counter(map(tuple, want.collect()))


def test_lines_are_screened_before_they_meet_the_journal(spark, small):
    """The word table of a screen is joined below the shuffle by journal or invoice."""
    books = load_order_books(spark, small)
    for frame in (pay.payroll_postings(books, ORDERS), sa.sales_lines(books, ORDERS, units=ORDERS.units)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "_bits" in plan and "strategy=broadcast" in plan
