"""Shape of the physical plans, and skew."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallywright.catalog.queries import QUERIES
from tallywright.operators import diagnostics as di
from tallywright.operators import payroll as pay
from tallywright.operators.apportion import apportion_total, month_shares
from tallywright.plans import statement as st
from tallywright.rules import ORDERS
from tallywright.sources.order_books import order_books
from tallywright.sources.tables import load_tables


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_no_python(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)


def test_scan_reads_only_what_is_used(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = QUERIES["sales_monthly"](spark, small)._jdf.queryExecution().toString()
    scans = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
    lineitem = next(s for s in scans if "l_extendedprice" in s)
    assert "l_shipdate" not in lineitem and "l_tax" not in lineitem
    orders = next(s for s in scans if "o_orderdate" in s)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "o_totalprice" not in orders


def test_top_n_limits_before_the_shuffle(spark, small):
    plan = plan_of(QUERIES["topn_counterparty"](spark, small))
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


def test_payroll_reads_the_ledger_once(spark, small):
    frame = QUERIES["payroll_hybrid_monthly"](spark, small)
    frame.collect()
    # the cutoff subquery takes the shuffle of the cells it is compared with
    assert re.search(r"ReusedExchange \[role#", plan_of(frame))


# ── skew: one account, month and journal hold most rows ─────────────────────────────────────


@pytest.fixture(scope="module")
def skewed(spark, small, tmp_path_factory):
    """The small tables, with one order, part and supplier on two thirds of all lines."""
    t = load_tables(spark, small)
    salary = t["part"].filter((F.col("p_brand") == "Brand#3") & (F.col("p_type") == "ECONOMY")).agg(F.min("p_partkey")).first()[0]
    order = (
        t["orders"].filter((F.col("o_orderdate").between("1997-01-01", "1999-01-01")) & F.col("o_orderpriority").startswith("1"))
        .agg(F.min("o_orderkey"))
        .first()[0]
    )
    hot = F.col("l_linenumber") > 2
    lines = t["lineitem"].withColumns(
        {
            "l_orderkey": F.when(hot, F.lit(order)).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(hot, F.lit(salary)).otherwise(F.col("l_partkey")),
            "l_suppkey": F.when(hot, F.lit(3)).otherwise(F.col("l_suppkey")),
        }
    )
    path = str(tmp_path_factory.mktemp("skew") / "lineitem")
    lines.write.parquet(path)
    return order_books({**{k: t[k] for k in t}, "lineitem": spark.read.schema(lines.schema).parquet(path)}), path


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    # small enough for the test data to count as skewed
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for key in (
        "spark.sql.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.autoBroadcastJoinThreshold",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    ):
        spark.conf.unset(key)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_hot_account_is_whole_and_its_join_is_split(spark, skewed, no_broadcast):
    books, path = skewed
    frame = di.account_activity(books, dt.date(1996, 1, 1))
    got = {r["account_no"]: r["moves_total"] for r in frame.collect()}
    want = {r["l_partkey"]: r["count"] for r in spark.read.parquet(path).groupBy("l_partkey").count().collect()}
    assert {int(number[1:]): n for number, n in got.items()} == want
    assert "skew=true" in plan_of(frame)


def test_hot_cell_gives_the_same_rows_as_brute_force(skewed, no_broadcast):
    books, _ = skewed
    rows = pay.payroll_postings(books, ORDERS, (pay.ACCRUAL,))
    kept = pay.base_or_provision(rows, pay.payroll_cells(rows))
    local = rows.select("account_no", "month", "category", "amount").collect()
    base = {}
    for r in local:
        if r["category"] == "base":
            base[r["account_no"], r["month"]] = base.get((r["account_no"], r["month"]), 0) + r["amount"]
    want = [r for r in local if (r["category"] == "base") == (base.get((r["account_no"], r["month"]), 0) != 0)]
    assert kept.count() == len(want)
    assert kept.agg(F.sum("amount")).first()[0] == sum(r["amount"] for r in want)


# ── operators on literal frames ─────────────────────────────────────────────────────────────


def test_shares_add_up_and_zero_totals_are_null(spark):
    amounts = spark.createDataFrame([("A", "m1", 3.0), ("B", "m1", 1.0), ("A", "m2", 0.0)], "unit string, month string, amount double")
    pool = spark.createDataFrame([("m1", 8.0), ("m3", 5.0)], "month string, pool double")
    shares = month_shares(amounts)
    assert {(r["unit"], r["month"]): r["share"] for r in shares.collect()} == {("A", "m1"): 0.75, ("B", "m1"): 0.25, ("A", "m2"): None}
    parts = {(r["unit"], r["month"]): r["amount"] for r in apportion_total(shares, pool).collect()}
    assert parts[("A", "m1")] + parts[("B", "m1")] == 8 and parts[("A", "m2")] is None


def test_top_parties_ties_go_by_name(spark):
    rows = [("A", "g", "x", p, "m", a) for p, a in (("b", 5.0), ("a", -5.0), ("c", 9.0), ("d", 1.0))]
    months = spark.createDataFrame(rows, "unit string, pnl_group string, concept string, party string, month string, amount double")
    assert {r["party"] for r in st.top_parties(months, 2).collect()} == {"c", "a"}


def test_top_parties_hold_totals_only(spark, small):
    # nothing that grows with months or parties is collected on the way to the winners
    for name in ("topn_counterparty", "statement_rows"):
        plan = plan_of(QUERIES[name](spark, small))
        assert "collect_list" not in plan and re.search(r"WindowGroupLimit .*Partial", plan)


def test_months_of_winners_only(spark):
    rows = [("A", "g", "x", p, m, a) for p, m, a in (("b", "1", 5.0), ("b", "2", -5.0), ("a", "1", 9.0), ("c", "1", 1.0))]
    months = spark.createDataFrame(rows, "unit string, pnl_group string, concept string, party string, month string, amount double")
    best = st.top_parties(months, 1)
    assert [(r["party"], r["total"]) for r in best.collect()] == [("b", 10.0)]
    assert sorted((r["party"], r["month"], r["amount"]) for r in st.months_of(best, months).collect()) == [("b", "1", 5.0), ("b", "2", -5.0)]


def test_reconcile_frames_is_full_outer(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "month date, amount double")
    right = spark.createDataFrame([(dt.date(2024, 2, 1), 2.0)], "month date, amount double")
    rows = {r["month"].month: (r["left_amount"], r["right_amount"], r["is_fallback"]) for r in pay.reconcile_frames(left, right, dt.date(2024, 1, 1)).collect()}
    assert rows == {1: (1.0, None, False), 2: (None, 2.0, True)}
