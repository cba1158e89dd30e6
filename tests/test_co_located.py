"""Bucketed ledger tables: same rows, no shuffle by journal, months that are not opened."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from test_plans import plan_of

from tallywright.operators import diagnostics as di
from tallywright.operators import ledger as le
from tallywright.plans import pnl as pl
from tallywright.rules import ORDERS
from tallywright.sources.co_located import hot_journals, store_ledger
from tallywright.sources.order_books import order_books
from tallywright.sources.tables import load_tables

BUCKETS = 8


@pytest.fixture(scope="module")
def both(spark, small, tmp_path_factory):
    """Books on the plain tables with a third of all lines in one journal, and the same co-located."""
    t = load_tables(spark, small)
    late = t["orders"].agg(F.max("o_orderkey")).first()[0]
    lines = t["lineitem"].withColumn("l_orderkey", F.when(F.col("l_linenumber") <= 2, F.lit(late)).otherwise(F.col("l_orderkey")))
    folder = str(tmp_path_factory.mktemp("ledger"))
    lines.write.parquet(f"{folder}/lineitem")
    plain = order_books(t.replaced(lineitem=spark.read.schema(lines.schema).parquet(f"{folder}/lineitem")))
    return plain, store_ledger(plain, folder, "co_test", BUCKETS), folder


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(map(str, frame.select(*columns).collect()))


def test_same_ledger_activity_and_pnl(both):
    plain, stored, _ = both
    assert rows_of(le.ledger_fact(stored, ORDERS)) == rows_of(le.ledger_fact(plain, ORDERS))
    since = dt.date(1998, 3, 1)
    assert rows_of(le.ledger_by_party(stored, ORDERS, since)) == rows_of(le.ledger_by_party(plain, ORDERS, since))
    assert rows_of(di.account_activity(stored, since)) == rows_of(di.account_activity(plain, since))
    assert rows_of(pl.pnl_long(stored, ORDERS)) == rows_of(pl.pnl_long(plain, ORDERS))


def test_the_hot_journal_is_apart_and_no_other(both):
    plain, stored, _ = both
    hot = hot_journals(plain["journal_line"], BUCKETS).collect()
    assert len(hot) == 1
    assert {r[0] for r in stored["hot_posting"].select("journal_id").distinct().collect()} == {hot[0][0]}
    assert stored["co_line"].where(F.col("journal_id") == hot[0][0]).count() == 0
    assert stored["hot_posting"].count() + stored["co_line"].count() == plain["journal_line"].count()


def test_no_exchange_between_lines_and_journals(spark, both):
    plain, stored, _ = both
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        accounts = F.broadcast(plain["account"])
        assert "Exchange hashpartitioning(journal_id" in plan_of(le.journal_rows(plain, accounts))
        for frame in (le.journal_rows(stored, accounts), le.ledger_fact(stored, ORDERS, accounts=accounts, with_party=False)):
            frame.collect()
            plan = plan_of(frame)
            assert "SortMergeJoin [journal_id" in plan and "Exchange hashpartitioning" not in plan
            assert f"SelectedBucketsCount: {BUCKETS} out of {BUCKETS}" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_months_before_the_floor_are_not_opened(both):
    _, stored, folder = both
    since = dt.date(2000, 6, 15)
    rows = le.postings(stored, ORDERS, stored["account"], since)
    files = [f for f in rows.inputFiles() if "co_test_line" in f]
    there = [os.path.join(at, n) for at, _, names in os.walk(f"{folder}/co_test_line") for n in names if n.endswith(".parquet")]
    assert 0 < len(files) < len(there) / 2
    assert {f.split("load_month=")[1][:7] for f in files} == {m for p in there if (m := p.split("load_month=")[1][:7]) >= "2000-06"}
    assert rows.agg(F.min("loaded_at")).first()[0].date() >= since


def test_prepared_postings_are_pruned_too(both, tmp_path):
    plain, _, _ = both
    prepared = le.prepare_postings(plain, str(tmp_path / "postings"))
    rows = le.postings(prepared, ORDERS, plain["account"], dt.date(2000, 6, 15))
    assert "load_month" not in rows.columns
    rows.collect()
    assert "PartitionFilters: [isnotnull(load_month" in plan_of(rows)
    assert rows_of(rows) == rows_of(le.postings(plain, ORDERS, plain["account"], dt.date(2000, 6, 15)))
