"""The P&L kept by batches equals the one computed at once, whatever arrives late."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from erp_tables import JOURNALS, ROWS, day, erp_tables, policy
from test_erp import RULES

from tallywright.plans import pnl as pl
from tallywright.plans.incremental import PnlStore
from tallywright.sources.erp_books import erp_books

LATE_JOURNALS = [
    # the salaries of March sum to zero now and fall back to the provision; the reversal is no base row
    ("l1", "2024-03-31", "2024-07-01", 9, None, "Anula sueldos", [("a-op", 1, 1100.0)]),
    # salaries of April and May: the last closed month moves from March to May
    ("l2", "2024-04-30", "2024-07-02", 9, None, "Sueldos", [("a-op", 0, 70.0)]),
    ("l3", "2024-05-31", "2024-07-02", 9, None, "Sueldos", [("b-op", 0, 80.0)]),
    # and back to April: May is booked out, without a provision
    ("l4", "2024-05-31", "2024-07-03", 9, None, "Sueldos", [("b-op", 1, 80.0)]),
    # an expense of January, and a month that had nothing
    ("l5", "2024-01-20", "2024-01-20", 8, "c1", "Factura tarde", [("x-up", 0, 33.0)]),
    ("l6", "2024-09-01", "2024-09-01", 8, "c1", "Factura", [("x-up", 0, 5.0)]),
    ("l7", "2024-09-02", "2024-09-02", 8, "c1", "anulación", [("x-up", 0, 5.0)]),
]
ALL = [*JOURNALS, *LATE_JOURNALS]
# journals of each batch; the rest comes first
BATCHES = [("second", {"j01", "j12", "l1"}), ("third", {"l2", "l3"}), ("fourth", {"l4", "l5"}), ("fifth", {"l6"}), ("sixth", {"l7"}), ("nothing", set())]
FIRST = {j[0] for j in ALL} - set().union(*(names for _, names in BATCHES))
LATE_INVOICES = {"f3"}


def lines(names):
    return [(j, account, side, amount, 0, f"mv-{account}") for j, _, _, _, _, _, items in ALL if j in names for account, side, amount in items]


@pytest.fixture(scope="module")
def books_of(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    headers = [(j, day(a), day(x), o, ref, text) for j, a, x, o, ref, text, _ in ALL]

    def books(names, invoices):
        items = [r for r in ROWS["facturasitems"] if r[0] in invoices]
        tables = erp_tables(spark, asientos=headers, asientositems=lines(names), facturasitems=items)
        return erp_books(tables, policy(spark))

    yield books
    spark.conf.unset("spark.sql.codegen.wholeStage")


def rows_of(frame):
    return sorted((r["unit"], r["pnl_group"], r["concept"], r["month"], float(r["amount"])) for r in frame.collect())


def files_by_month(folder):
    return {d: sorted(os.listdir(os.path.join(folder, "pnl", d))) for d in os.listdir(os.path.join(folder, "pnl")) if d.startswith("pnl_month=")}


def test_batches_add_up_and_leave_other_months_alone(spark, books_of, tmp_path):
    store = PnlStore(spark, str(tmp_path), RULES).create()
    assert store.pnl().collect() == []
    have, invoices = set(FIRST), {r[0] for r in ROWS["facturasitems"]} - LATE_INVOICES
    store.apply(books_of(have, invoices), "first")
    assert rows_of(store.pnl()) == rows_of(pl.pnl_long(books_of(have, invoices), RULES))
    computed = {}
    for name, names in BATCHES:
        late = LATE_INVOICES if name == "fourth" else set()
        before = files_by_month(tmp_path)
        computed[name] = store.apply(books_of(names, late), name)
        have, invoices = have | names, invoices | late
        assert rows_of(store.pnl()) == rows_of(pl.pnl_long(books_of(have, invoices), RULES)), name
        after = files_by_month(tmp_path)
        assert {m.removeprefix("pnl_month=") for m in after if after[m] != before.get(m)} == set(computed[name])
    # forward: April and May change their method; back: May alone, beside January and February of the late rows
    assert computed["third"] == ["2024-04", "2024-05"]
    assert computed["fourth"] == ["2024-01", "2024-02", "2024-05"]
    assert computed["sixth"] == ["2024-09"] and computed["nothing"] == []


def test_a_batch_applied_again_replaces_itself(spark, books_of, tmp_path):
    store = PnlStore(spark, str(tmp_path), RULES).create()
    everything = {r[0] for r in ROWS["facturasitems"]}
    store.apply(books_of(FIRST, everything), "first")
    store.apply(books_of({"l2", "l5"}, set()), "second")
    once = rows_of(store.pnl())
    store.apply(books_of({"l2", "l5"}, set()), "second")
    assert rows_of(store.create().pnl()) == once == rows_of(pl.pnl_long(books_of(FIRST | {"l2", "l5"}, everything), RULES))


def test_only_the_months_of_a_batch_are_read(spark, books_of, tmp_path):
    store = PnlStore(spark, str(tmp_path), RULES).create()
    store.apply(books_of(FIRST | {"j01"}, set()), "first")
    cells = store.cells(["2024-01"])
    assert cells.count() > 0
    assert {f.split("cell_month=")[1][:7] for f in cells.inputFiles()} >= {"2024-01", "2024-03"}  # all are listed,
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell_month" in plan or "PartitionFilters: [cell_month" in plan  # one is read
    assert {r["month"] for r in cells.collect()} == {dt.date(2024, 1, 1)}
