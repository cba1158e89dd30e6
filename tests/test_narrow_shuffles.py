"""What crosses the wide shuffles of the ledger, and how pivots are dealt to tasks."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest

from tallywright.operators import expenses as ex
from tallywright.operators import ledger as le
from tallywright.operators import payroll as pay
from tallywright.plans import pnl as pl
from tallywright.plans import variants as va
from tallywright.rules import ORDERS
from tallywright.schemas import Books
from tallywright.sources.order_books import load_order_books


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def journal_joins(frame):
    """Columns on both sides of every join by journal."""
    found = []
    for node in nodes(frame._jdf.queryExecution().optimizedPlan()):
        if node.nodeName() == "Join" and "journal_id" in node.condition().toString():
            found.append(node.left().output().mkString(",") + "," + node.right().output().mkString(","))
    return found


ROWS = {
    "payroll": lambda b: pay.payroll_postings(b, ORDERS),
    "expenses": lambda b: ex.expense_rows(b, ORDERS),
    "result accounts": lambda b: le.ledger_line_first(b, ORDERS, dt.date(1998, 1, 1)),
    "every account": lambda b: va.expense_pivot(b, ORDERS, dt.date(1998, 1, 1), ["1998-01"]),
}


@pytest.mark.parametrize("name", ROWS)
def test_no_account_text_crosses_the_shuffle_by_journal(spark, small, name):
    joins = journal_joins(ROWS[name](load_order_books(spark, small)))
    assert joins
    for columns in joins:
        assert not any(text in columns for text in ("account_no", "item_name", "p_name", "concept", "class_code", "p_brand"))


def test_expenses_read_journals_of_their_origins_only(spark, small):
    plan = ex.expense_rows(load_order_books(spark, small), ORDERS)._jdf.queryExecution().optimizedPlan()
    join = next(n for n in nodes(plan) if n.nodeName() == "Join" and "journal_id" in n.condition().toString())
    assert "Filter" in join.right().toString() and "IN (1,2)" in join.right().toString()


@pytest.fixture(scope="module")
def books(spark):
    """Journal 1 twice, account 10 twice, account 20 not listed; ids that are null or unknown."""
    day = dt.datetime(1999, 3, 5)
    lines = [(j, a, day, 0, Decimal(cents), "N", None) for j, a, cents in ((1, 10, 100), (1, 10, 100), (1, 20, 7), (2, 10, 5), (None, 10, 9), (1, None, 11), (3, 10, 13), (2, 30, 17))]
    tables = {
        "journal_line": (lines, "journal_id long, account_id long, loaded_at timestamp_ntz, side int, amount decimal(18,2), line_flag string, origin_id long"),
        "journal": ([(1, day, 1, "1-URGENT"), (1, day, 2, "2-HIGH"), (2, day, 3, "3-MEDIUM"), (None, day, 1, "1-URGENT")], "journal_id long, accounting_at timestamp_ntz, origin_code int, priority string"),
        "account": ([(10, "400", "one"), (10, "400", "two"), (30, None, "none"), (None, "500", "null")], "account_id long, account_no string, account_name string"),
    }
    return Books({name: (lambda rows=rows, schema=schema: spark.createDataFrame(rows, schema)) for name, (rows, schema) in tables.items()})


def _rows(frame):
    columns = sorted(frame.columns)
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def test_texts_last_gives_the_rows_of_texts_first(books):
    accounts = books["account"].filter("account_name <> 'none'")
    want = le.journal_rows(books, accounts)
    assert _rows(le.listed_rows(books, accounts)) == _rows(want)
    assert sum(_rows(want).values()) == 10
    high = le.listed_rows(books, accounts, ex.possible_origin(ORDERS))
    assert _rows(high) == _rows(want.filter("origin_code IN (1, 2)"))


def test_account_months_equal_sums_of_rows(books):
    accounts = books["account"]
    got = le.account_months(books, ORDERS, accounts)
    want = le.journal_rows(books, accounts).groupBy("account_id", "account_no", "account_name").agg({"amount": "sum"})
    assert Counter((r[0], r["account_no"], r["account_name"], r["amount"]) for r in got.collect()) == Counter(tuple(r) for r in want.collect())


def test_pivot_deals_keys_to_every_partition(spark):
    rows = [("a", "1999-01-01", 1), ("a", "1999-01-01", 2), (None, "1999-02-01", 4), ("b", "2000-01-01", 8), ("b", None, 16)]
    frame = spark.createDataFrame(rows, "k string, m string, amount long").selectExpr("k", "date(m) AS month", "amount")
    wide = pl.pivot_months(frame, ["k"], ["1999-01", "1999-02"])
    assert {tuple(r) for r in wide.collect()} == {("a", 3, None, None), (None, None, 4, None), ("b", None, None, 24)}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        plan = pl.pivot_months(frame, ["k"], ["1999-01"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert "hashpartitioning(k#" in plan and "7), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1


def test_payroll_rows_and_cells_share_the_shuffle_by_journal(spark, small):
    plan = pay.payroll_fact(load_order_books(spark, small), ORDERS)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan) if n.nodeName() == "Join" and "journal_id" in n.condition().toString()]
    # the same plan below the exchange on each side, so that one exchange serves all
    assert len(joins) > 1
    assert len({n.left().canonicalized().toString() for n in joins}) == 1
    assert len({n.right().canonicalized().toString() for n in joins}) == 1
