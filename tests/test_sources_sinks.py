"""Readers and writers."""

from __future__ import annotations

import datetime as dt
import os
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.operators.diagnostics import latest_rates
from tallywright.plans.pnl import pivot_months
from tallywright.schemas import Books
from tallywright.sinks import report
from tallywright.sources import files, tables


@pytest.fixture
def long(spark):
    rows = [("A", "g", "x", "2024-01-01", "1.50"), ("A", "g", "x", "2024-02-01", "2.00"), ("B", "g", "y", "2024-02-01", "-3.00")]
    frame = spark.createDataFrame(rows, "unit string, pnl_group string, concept string, month string, amount string")
    return frame.withColumn("month", F.col("month").cast("date")).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_tables_are_lazy_and_described(spark, small):
    loaded = tables.load_tables(spark, small)
    rows = tables.describe_tables(spark, loaded).collect()
    assert {r["table_name"] for r in rows} == set(tables.ORDER_TABLES)
    # the declared types are those in the files
    for name in tables.ORDER_TABLES:
        inferred = spark.read.parquet(os.path.join(small, f"{name}.parquet"))
        assert [f.dataType for f in inferred.schema] == [f.dataType for f in loaded[name].schema]


def test_missing_key_column_is_refused(spark):
    books = Books({"invoice": lambda: spark.range(1)})
    with pytest.raises(ValueError, match="contact_id"):
        books["invoice"]


def test_policy_and_category_files(spark, tmp_path):
    (tmp_path / "plan.csv").write_text(
        "Nro,Nv,T,Nombre,C,M,S,I,_,Usar\n42101001.0,1,g,BSAS ALQUILER,,,0,1,, si \n42101002,1,g,OTRA,,,0,1,,No\n", encoding="utf-8"
    )
    policy = files.load_account_policy(spark, str(tmp_path / "plan.csv"))
    assert [r["account_no"] for r in files.considered_accounts(policy).collect()] == ["42101001"]
    (tmp_path / "cat.csv").write_text("Numero,Categoria\n42101001.0,3.X\n", encoding="utf-8")
    assert files.load_category(spark, str(tmp_path / "cat.csv")).collect()[0].asDict() == {"category_key": "42101001", "category": "3.X"}


def test_export_csv_with_mark_bytes_months_and_bad_dates(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text("﻿Mes,Fecha,Cant,Total\nb'2026-01',2026-01-05,3,1.10\nb'2026-02',no date,x,\n", encoding="utf-8")
    rows = files.load_export_csv(spark, str(path), months=("Mes",), moments=("Fecha",), decimals=("Total",), integers=("Cant",)).collect()
    assert [r["Mes"] for r in rows] == ["2026-01", "2026-02"]
    assert rows[0]["Fecha"] == dt.datetime(2026, 1, 5) and rows[1]["Fecha"] is None
    assert rows[0]["Total"] == Decimal("1.10") and rows[1]["Cant"] is None


def test_report_round_trip_long_and_wide(spark, long, tmp_path):
    wide = pivot_months(long, ["unit", "pnl_group", "concept"])
    done = report.write_report({"pnl": long, "wide": wide}, str(tmp_path), partition_by=("unit",), sort_within=("concept",))
    assert [(d.name, d.rows) for d in done] == [("pnl", 3), ("wide", 2)]
    assert {p for p in os.listdir(tmp_path / "pnl") if p.startswith("unit=")} == {"unit=A", "unit=B"}
    back = files.load_report(spark, str(tmp_path / "wide"))
    assert {(r["concept"], r["month"], r["amount"]) for r in back.collect()} == {
        ("x", "2024-01", Decimal("1.50")),
        ("x", "2024-02", Decimal("2.00")),
        ("y", "2024-02", Decimal("-3.00")),
    }
    assert files.load_report(spark, str(tmp_path / "pnl")).count() == 3


def test_failed_export_does_not_stop_the_others(spark, long, tmp_path):
    bad = long.select(F.raise_error(F.lit("broken query")).alias("x"))
    done = {d.name: d for d in report.export_all({"a": long, "bad": bad, "z": long.limit(1)}, str(tmp_path))}
    assert (done["a"].rows, done["z"].rows) == (3, 1)
    assert done["bad"].rows is None and done["bad"].error
    assert report.write_table(long, str(tmp_path / "one")).rows == 3


def test_months_outside_a_given_list_are_not_lost(spark, long):
    wide = pivot_months(long, ["unit"], ["1990-01"])
    assert wide.columns == ["unit", "1990-01", "other_months"]
    got = wide.agg({"other_months": "sum"}).first()[0]
    assert got == long.agg({"amount": "sum"}).first()[0]


def test_latest_rates(spark):
    rates = spark.createDataFrame([(i, float(i)) for i in range(40)], "rate_id int, rate double")
    got = [r["rate_id"] for r in latest_rates(Books({"fx_rate": lambda: rates}), 3).collect()]
    assert got == [39, 38, 37]


def test_rows_and_rejects_are_all_lines(spark, tmp_path):
    path = tmp_path / "in.csv"
    good = ["b'2026-01',2026-01-05,3,1.10,ok", ",,,,", "2026-02,2026-01-06 10:00:00, 4 ,-2,ok"]
    bad = ["2026-01,2026-01-05,3", "2026-01,no date,x,1.10,two cells", "2026-1,2026-01-05,3,1.105,month and cents", "2026-01,2026-01-05,3,1.10,too,many", "2026-01,2026-01-05,3.5,1.1,part"]
    path.write_text("Mes,Fecha,Cant,Total,Nota\n" + "\n".join(good + bad * 3) + "\n", encoding="utf-8")
    read = files.load_checked_csv(spark, str(path), ("Mes", "Fecha", "Cant", "Total", "Nota"), months=("Mes",), moments=("Fecha",), decimals=("Total",), integers=("Cant",))
    assert (read.lines, read.kept, read.rows.count(), read.rejects.count()) == (18, 3, 3, 15)
    assert read.reasons == {"record": 6, "Mes": 3, "Fecha": 3, "Cant": 6, "Total": 3}
    rows = sorted(map(tuple, read.rows.collect()), key=str)
    assert rows == sorted([("2026-01", dt.datetime(2026, 1, 5), 3, Decimal("1.10"), "ok"), (None, None, None, None, None), ("2026-02", dt.datetime(2026, 1, 6, 10), 4, Decimal("-2.00"), "ok")], key=str)
    # a rejected line is there as it was written, once for each time it was
    assert sorted(r["line"] for r in read.rejects.collect()) == sorted(bad * 3)
    assert {r["line"]: r["reasons"] for r in read.rejects.collect()}["2026-01,no date,x,1.10,two cells"] == ["Fecha", "Cant"]


def test_an_empty_export_has_no_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text("A,B\n", encoding="utf-8")
    read = files.load_checked_csv(spark, str(tmp_path / "in.csv"), ("A", "B"), integers=("B",))
    assert (read.lines, read.kept, read.reasons, read.rows.count(), read.rejects.count()) == (0, 0, {}, 0, 0)


def test_exports_run_side_by_side_and_one_failure_is_its_own(spark, long, tmp_path):
    bad = long.select(F.raise_error(F.lit("broken query")).alias("x"))
    meeting = threading.Barrier(3)

    def together(frame):
        def plan():
            meeting.wait(60)  # three exports are planned at one time, or none
            return frame

        return plan

    def unplanned():
        return long.select("no_such_column")

    queries = {"a": together(long), "bad": together(bad), "b": together(long.limit(1)), "unplanned": unplanned, "c": spark.range(5)}
    done = report.export_all(queries, str(tmp_path), at_once=3)
    assert [d.name for d in done] == list(queries)
    got = {d.name: d for d in done}
    assert (got["a"].rows, got["b"].rows, got["c"].rows) == (3, 1, 5)
    assert all(got[name].rows is None and got[name].error for name in ("bad", "unplanned"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 5
    assert report.export_all({}, str(tmp_path)) == []
