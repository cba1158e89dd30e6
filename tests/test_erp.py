"""Operators over the accounting system's own tables: edge rows checked by hand."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from erp_tables import ACCOUNTS, erp_tables, policy
from pyspark.sql import functions as F

from tallywright.operators import accounts as ac
from tallywright.operators import diagnostics as di
from tallywright.operators import expenses as ex
from tallywright.operators import ledger as le
from tallywright.operators import parties as pa
from tallywright.operators import payroll as pay
from tallywright.operators import purchases as pu
from tallywright.operators import sales as sa
from tallywright.plans import margin as ma
from tallywright.plans import pnl as pl
from tallywright.plans import statement as st
from tallywright.plans import variants as va
from tallywright.rules import REGIONAL, DetailOverride, PartyOverride
from tallywright.sources.erp_books import erp_books

RULES = replace(
    REGIONAL,
    party_overrides=(PartyOverride("REASIGNADA SRL", "Salta", "Bsas ", "Pat "),),
    detail_overrides=(DetailOverride("PAGO ESPECIAL", "Salta", "01-Otros DA"),),
)


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    categories = spark.createDataFrame([("42101029", "2.SUELDOS")], "category_key string, category string")
    tables = erp_tables(spark) | {"policy": policy(spark), "categories": categories}
    folder = tmp_path_factory.mktemp("erp")
    for name, frame in tables.items():
        frame.write.parquet(str(folder / name))
    stored = {name: spark.read.parquet(str(folder / name)) for name in tables}
    # a handful of rows: compiling each plan would take longer than running it
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield erp_books(stored, stored.pop("policy"), stored.pop("categories"))
    spark.conf.unset("spark.sql.codegen.wholeStage")


def as_dict(frame, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in frame.collect()}


def month(text):
    return dt.date.fromisoformat(text + "-01")


# ── sales ───────────────────────────────────────────────────────────────────────────────────


def test_sales_amounts_signs_and_missing_rate(books):
    got = as_dict(sa.sales_monthly(books, RULES), ["unit", "month"], "amount")
    # f1: (1000 + 500.5) x 0.9, f2: credit note -100; the excluded product is out
    assert got[("Bs.As.", month("2024-01"))] == Decimal("1250.45")
    assert got[("Salta", month("2024-02"))] == Decimal("34010.00")
    # no rate: a row with a null amount, which sums to zero
    assert got[("Otros", month("2024-02"))] == 0
    # cancelled, too early and product-less invoices are out
    assert len(got) == 3


def test_document_labels(books):
    labels = {r["invoice_id"]: r["detail"] for r in sa.sales_lines(books, RULES).collect()}
    assert labels["f1"] == "Factura (A) 0003-00000012"
    assert labels["f2"].startswith("Nota de Crédito 0003-12345678")  # longer numbers stay whole
    assert labels["f3"] == "Nota de Débito () 0004-00000000"
    assert labels["f4"] == "Comprobante (B) 0009-00000003"


def test_first_invoices_have_no_filters_and_break_ties_by_id(books):
    got = {r["company"]: (r["invoice_id"], r["month"], r["unit"]) for r in sa.first_invoices(books, RULES).collect()}
    assert got == {
        "Empresa Uno": ("f6", month("2023-07"), "Bs.As."),
        "Empresa Dos": ("f3", month("2024-02"), "Salta"),  # f3, f4 and f7 on one day
    }
    assert {(r["month"], r["unit"]): r["new_customers"] for r in sa.new_customers(books, RULES).collect()} == {
        (month("2023-07"), "Bs.As."): 1,
        (month("2024-02"), "Salta"): 1,
    }


# ── payroll ─────────────────────────────────────────────────────────────────────────────────


def test_base_or_provision_per_account_and_month(books):
    cells = pay.payroll_cells(pay.payroll_postings(books, RULES, (pay.ACCRUAL,)))
    got = as_dict(cells, ["account_no", "month"], "amount")
    assert got[("42101029", month("2024-01"))] == Decimal("1000.10")
    assert got[("42101029", month("2024-02"))] == Decimal("777.77")  # base is exactly zero
    assert got[("42201029", month("2024-02"))] == Decimal("444.00")  # provision only
    assert got[("42101029", month("2024-03"))] == Decimal("1100.00")  # provision ignored, noise out
    rows = pay.base_or_provision(pay.payroll_postings(books, RULES, (pay.ACCRUAL,)), cells)
    by_cell = as_dict(
        rows.groupBy("account_no", "month").agg(F.sum("amount").alias("amount")), ["account_no", "month"], "amount"
    )
    assert by_cell == {k: v for k, v in got.items() if v is not None}


def test_base_zero_without_provision_leaves_nothing(spark):
    journals = [("j1", dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1), 9, None, "Sueldos")]
    lines = [("j1", "a-op", 0, 10.0, 0, None), ("j1", "a-op", 1, 10.0, 0, None)]
    books = erp_books(erp_tables(spark, asientos=journals, asientositems=lines), policy(spark))
    cells = pay.payroll_cells(pay.payroll_postings(books, RULES))
    assert [r["amount"] for r in cells.collect()] == [None]
    assert pay.payroll_cutoff(cells).collect()[0]["cutoff"] is None
    # no cutoff: neither closed nor later months
    assert pay.payroll_hybrid(books, RULES).count() == 0


def test_hybrid_payroll(books):
    got = as_dict(pay.payroll_hybrid(books, RULES), ["concept", "month"], "amount")
    want = {
        ("Sueldos Consultoría y operaciones - Bs.As.", "2024-01"): "1000.10",
        ("Sueldos Administración - Bs.As.", "2024-01"): "200",
        ("Cargas Sociales Consultoría y operaciones - Bs.As.", "2024-01"): "300",
        ("Sueldos - Salta", "2024-01"): "500",
        ("Sueldos Consultoría y operaciones - Bs.As.", "2024-02"): "777.77",
        ("Sueldos - Salta", "2024-02"): "444",
        ("Sueldos Consultoría y operaciones - Bs.As.", "2024-03"): "1100",
        # after the cutoff (2024-03): liability salaries, pooled charges by share 3/4 and 1/4
        ("Sueldos (sin clasificar) - Bs.As.", "2024-04"): "300",
        ("Sueldos - Salta", "2024-04"): "100",
        ("Cargas Sociales (sin clasificar) - Bs.As.", "2024-04"): "90",
        ("Cargas Sociales - Salta", "2024-04"): "30",
        # a month without pool has zero charges; a pool without salaries goes nowhere
        ("Sueldos (sin clasificar) - Bs.As.", "2024-05"): "200",
        ("Cargas Sociales (sin clasificar) - Bs.As.", "2024-05"): "0",
    }
    assert got == {(c, month(m)): Decimal(v) for (c, m), v in want.items()}


def test_apportioned_parts_add_up_to_the_pool(books):
    shares = va.liability_shares(books, RULES)
    parts = va.pool_by_row(books, RULES).filter(F.col("unit").isNotNull())
    got = as_dict(parts.groupBy("source", "month").agg(F.sum("amount").alias("amount")), ["source", "month"], "amount")
    assert got == {("Cargas Sociales", month("2024-04")): 80, ("Sindicato", month("2024-04")): 44}
    # the closing text is not looked at here: 9300 of 9400
    assert as_dict(shares, ["unit", "month"], "share")[("Bs.As.", month("2024-04"))] == pytest.approx(9300 / 9400)
    # the pool row of the month without salaries stays, without a unit
    assert va.pool_by_row(books, RULES).filter(F.col("unit").isNull()).count() == 1


def test_per_unit_cutoff_lets_a_late_unit_fall_back(books):
    got = as_dict(pay.payroll_hybrid(books, RULES, per_unit_cutoff=True), ["concept", "month"], "amount")
    assert ("Sueldos - Salta", month("2024-02")) in got
    assert ("Sueldos - Salta", month("2024-04")) in got


def test_reconciliation_and_fallback_list(books):
    comparison = pay.reconcile(books, RULES)
    got = {r["month"]: (r["owed"], r["accrued"], r["is_fallback"]) for r in comparison.collect()}
    assert got[month("2024-01")] == (None, Decimal("1200.10"), False)
    assert got[month("2024-04")] == (Decimal("300.00"), None, True)
    assert pay.fallback_months(comparison).collect()[0].asDict() == {"months": 2, "month_list": "2024-04,2024-05"}


def test_payroll_split_has_both_columns(books):
    got = {(r["kind"], r["month"]): r for r in pay.payroll_split(books, RULES).collect()}
    january = got[("Sueldos", month("2024-01"))]
    assert (january["operations"], january["administration"]) == (Decimal("1000.10"), Decimal("200.00"))
    assert (january["operations_pct"], january["administration_pct"]) == (83.3, 16.7)
    assert got[("Cargas Sociales", month("2024-01"))]["administration"] == 0


# ── expenses ────────────────────────────────────────────────────────────────────────────────


def test_expenses_selection_signs_units_overrides(books):
    got = as_dict(ex.expenses_monthly(books, RULES), ["unit", "account_no", "concept"], "amount")
    assert got == {
        ("Bs.As.", "42101056", "Bsas Mantenimiento"): Decimal("70.00"),  # 100 - credit note 30
        ("Bs.As.", "42101077", "Bsas Patentes"): Decimal("10.00"),  # both patterns: the first wins
        ("Salta", "42101077", "Pat Patentes"): Decimal("7.00"),  # re-assigned party
        ("Salta", "42201001", "Pat Alquileres"): Decimal("3.00"),
        ("Salta", "42201001", "Pat Alquileres Y Expensas"): Decimal("4.00"),
        ("Bs.As.", "42102025", "Bsas Agua-Luz"): Decimal("11.00"),  # the exception, not a purchase
        ("Salta", "42101056", "01-Otros DA"): Decimal("15.00"),  # re-assigned by its text
    }


def test_literal_mode_counts_twice_what_both_lists_select(books):
    got = as_dict(ex.expenses_monthly(books, RULES, literal=True, consistent=False), ["unit", "concept"], "amount")
    assert got[("Bs.As.", "Bsas Mantenimiento")] == Decimal("170.00")  # (100 - 30 + 15) x 2
    assert got[("Bs.As.", "Bsas Patentes")] == Decimal("10.00")


def test_policy_flags_and_canonical_numbers(books):
    rows = {r["account_no"]: r["unit"] for r in ac.policy_by_number(books["account_policy"], RULES).collect()}
    assert rows == {
        "42101029": "Bs.As.",
        "42101056": "Bs.As.",
        "42101077": "Bs.As.",
        "42102025": "Bs.As.",
        "42201001": "Salta",
    }
    preferred = {r["account_no"]: r["considered"] for r in ac.policy_preferred(books["account_policy"]).collect()}
    assert preferred["42201001"] is True and preferred["42303002"] is False


# ── P&L, margin, statement ──────────────────────────────────────────────────────────────────


def test_pnl_adds_up_to_the_fact(books):
    pnl = pl.pnl_long(books, RULES)
    fact = pl.movements(books, RULES)
    by_group = lambda f: as_dict(f.groupBy("unit", "pnl_group", "month").agg(F.sum("amount").alias("amount")), ["unit", "pnl_group", "month"], "amount")
    assert by_group(pnl) == by_group(fact)


def test_margin_and_statement(books):
    pnl = pl.pnl_long(books, RULES)
    monthly = {(r["unit"], r["month"]): r for r in ma.margin_monthly(pnl).collect()}
    january = monthly[("Bs.As.", month("2024-01"))]
    assert january["margin"] == Decimal("1250.45") - Decimal("1500.10") - Decimal("91.00")
    assert january["margin_pct"] == pytest.approx(float(january["margin"]) / 1250.45 * 100)
    assert monthly[("Salta", month("2024-01"))]["margin_pct"] is None  # no sales
    assert ma.margin_monthly(pnl, ()).count() == 0  # no year selected
    assert {r["margin_pct"] for r in ma.margin_total(pnl, (2030,)).collect()} == set()

    rows = st.statement_rows(pnl, pl.movements(books, RULES), 1).collect()
    details = [r for r in rows if r["level"] == 2]
    assert {(r["concept"], r["party"]) for r in details if r["concept"].startswith("00-")} == {
        ("00-Ventas netas - Bs.As.", "Empresa Uno"),
        ("00-Ventas netas - Salta", "Empresa Dos"),
    }
    # payroll concepts of the fact have no line of their own in the P&L, so they are not opened
    assert not [r for r in details if r["concept"].startswith("01-Sueldos")]
    assert {r["label"] for r in rows if r["level"] == 0} == {"Ventas", "RRHH", "Egresos"}


def test_pivot_finds_its_months_and_leaves_gaps_null(books):
    wide = pl.pnl_pivot(pl.pnl_long(books, RULES))
    assert wide.columns[3:] == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    row = {r["concept"]: r for r in wide.collect()}["00-Ventas netas - Bs.As."]
    assert row["2024-01"] == Decimal("1250.45") and row["2024-02"] is None


def test_order_puts_listed_concepts_first(books):
    concepts = [r["concept"] for r in pl.pnl_ordered(pl.pnl_long(books, RULES), RULES).filter("unit = 'Salta'").collect()]
    first = list(dict.fromkeys(concepts))
    assert first[:3] == ["00-Ventas netas - Salta", "01-Sueldos - Salta", "01-Cargas Sociales - Salta"]
    assert first[3:] == sorted(first[3:])


# ── ledger and parties ──────────────────────────────────────────────────────────────────────


def test_header_without_lines_stays_in_the_fact(books):
    rows = {r["journal_id"]: r for r in le.ledger_fact(books, RULES).filter("journal_id = 'j30'").collect()}
    assert rows["j30"]["account_no"] is None and rows["j30"]["party"] == "Ficticia SA"
    unknown = le.ledger_fact(books, RULES).filter("origin_code = 0").collect()
    assert {r["origin"] for r in unknown} == {None}


def test_prepared_postings_give_the_same_pnl(books, tmp_path):
    prepared = le.prepare_postings(books, str(tmp_path / "postings"))
    key = ["unit", "concept", "month"]
    assert as_dict(pl.pnl_long(prepared, RULES), key, "amount") == as_dict(pl.pnl_long(books, RULES), key, "amount")


def test_movement_party_line_first_and_movement_first(books):
    since = dt.date(2024, 1, 1)
    lines = le.ledger_by_party(books, RULES, since)
    moves = le.ledger_by_party(books, RULES, since, movement_first=True)
    assert lines.count() > moves.count() > 0
    assert {r["party"] for r in moves.collect()} == {"Ficticia SA", " reasignada srl ", None}


def test_contact_report_is_one_to_one_and_clean(books):
    rows = {(r["last_name"], r["company"]): r for r in pa.contact_report(books).collect()}
    dos = rows[("Ejemplo", "Empresa Dos")]
    assert dos["first_name"] == "Beto" and dos["email"] is None
    assert dos["created_at"] == dt.datetime(2023, 7, 1) and dos["last_invoice"] == dt.datetime(2024, 2, 2)
    assert rows[("Prueba", "Empresa Uno")]["segment"] == "Agro"
    assert {r["last_name"] for r in pa.contacts_with_invoice(books).collect()} == {"Prueba", "Ejemplo"}
    assert [r["last_name"] for r in pa.by_recency(pa.contact_report(books)).collect()][-1] == "Modelo"


def test_supplier_report(books):
    outputs = pa.supplier_outputs(books, dt.date(2024, 6, 1), dt.date(2024, 3, 1))
    row = outputs["all"].collect()
    assert [(r["company"], r["documents"], r["amount"]) for r in row] == [("Proveedora Tres", 2, Decimal("123.00"))]
    assert outputs["active_by_purchase"].count() == 1 and outputs["new_by_creation"].count() == 0
    assert outputs["last_year"].count() == 1


def test_recent_parties(books):
    customers = {r["company"]: (r["tax_id"], r["last_invoice"]) for r in pa.recent_customers(books, dt.date(2024, 1, 6)).collect()}
    assert customers == {"Empresa Uno": ("30-2", "06/01/2024"), "Empresa Dos": (None, "02/02/2024")}
    suppliers = {(r["party"], r["last_purchase"]) for r in pa.recent_suppliers(books, dt.date(2023, 1, 1)).collect()}
    assert suppliers == {("Ficticia SA", "11/03/2024")}


def test_searches_ignore_case_and_keep_ids(books):
    found = {(r["party"], r["fiscal_id"]) for r in di.party_search(books, ["ficticia"]).collect()}
    assert found == {("Ficticia SA", "s1"), ("FICTICIA SA", "s3")}
    assert di.ledger_search(books, RULES, ["FICTICIA"]).count() == 5
    accounts = {r["account_no"] for r in ac.account_search(books, "1.2", ["ehiculo", "anteni"]).collect()}
    assert accounts == {"12101001", "42101056", "42209999"}
    rates = {r["purchase_id"]: r["rate"] for r in pu.purchase_rates(books, ["reasignada", "Ficticia"]).collect()}
    assert rates["c1"] == Decimal("850.2500") and rates["c2"] is None


def test_activity_and_inventory(books):
    rows = {(r["account_no"], r["account_name"]): r for r in di.account_activity(books, dt.date(2024, 1, 1)).collect()}
    upkeep = rows[("42101056", "BSAS MANTENIMIENTO")]
    assert (upkeep["moves_total"], upkeep["moves_recent"], upkeep["journals"]) == (7, 6, 7)
    inventory = {r["account_no"]: r for r in di.account_inventory(books, RULES, dt.date(2024, 1, 1)).collect()}
    # two descriptions of one number are one row; "No" accounts are out
    assert inventory["42201001"]["moves_recent"] == 2 and inventory["42201001"]["label"] == "Alquileres"
    assert "42209999" not in inventory and inventory["42101077"]["unit"] == "Bs.As."
    totals = {r["unit"]: r["accounts"] for r in di.inventory_totals(di.account_inventory(books, RULES, dt.date(2024, 1, 1))).collect()}
    assert totals == {"Bs.As.": 4, "Salta": 1}


def test_diagnostic_exports_agree_with_each_other(books):
    codes = tuple(RULES.accrual_kinds)
    profile = di.noise_profile(books, RULES, codes)
    matrix = di.date_shift_matrix(books, RULES, codes)
    key = ["accounting_month", "account_no", "side"]
    total = lambda f: as_dict(f.groupBy(*key).agg(F.sum("total").alias("total")), key, "total")
    assert total(profile) == total(matrix)
    by_origin = as_dict(matrix.groupBy("origin_code", "side").agg(F.sum("n").alias("n")), ["origin_code", "side"], "n")
    assert by_origin == as_dict(di.origin_distribution(books, RULES, codes), ["origin_code", "side"], "n")
    closing = {r["category"] for r in profile.filter("account_no = '42101029'").collect()}
    assert closing == {"4_cierre", "2_infl", "3_reversion", "3_provision", "1_base"}


def test_asset_range_is_half_open(books):
    day = lambda y, m, d: dt.date(y, m, d)
    assert di.asset_monthly(books, RULES, "1", day(2024, 1, 1), day(2024, 1, 16)).count() == 0
    assert di.asset_monthly(books, RULES, "1", day(2024, 1, 1), day(2024, 1, 17)).count() == 1


def test_older_variants_run_on_these_tables(books):
    since = dt.date(2024, 1, 1)
    long = {(r["concept"], r["category"]) for r in va.margin_long(books, RULES, since).collect()}
    assert ("Bsas Sueldos", "2.SUELDOS") in long and ("Pat Sueldos", "1.VENTAS") in long
    bought = va.margin_from_purchases(books, RULES, since).filter(F.col("party").isNotNull()).collect()
    assert sorted((r["voucher_name"], r["balance"]) for r in bought) == [
        ("Factura", Decimal("-100")),
        ("Factura", Decimal("-20")),
        ("Nota de Credito", Decimal("7")),
    ]
    assert va.expense_pivot(books, RULES, since).count() == len(ACCOUNTS)
    pnl = va.pnl_liability_method(books, RULES)
    names = {r["concept"] for r in pnl.collect()}
    assert {"01-Sindicato - Bs.As.", "01-Sueldos Y Jornales A Pagar Bs As"} <= names
