"""Every operator as a named query over the order / line-item tables.

A query is a function of (spark, folder). Money comes out as DOUBLE rounded to cents, months as
``yyyy-MM`` text and moments as ``yyyy-MM-dd`` text, so that any SQL engine can be compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as cl
from ..functions import money as mo
from ..functions import periods as pe
from ..functions import text as tx
from ..operators import accounts as ac
from ..operators import diagnostics as di
from ..operators import expenses as ex
from ..operators import ledger as le
from ..operators import ordering as od
from ..operators import parties as pa
from ..operators import payroll as pay
from ..operators import purchases as pu
from ..operators import rule_table as rt
from ..operators import sales as sa
from ..plans import incremental as inc
from ..plans import margin as ma
from ..plans import pnl as pl
from ..plans import statement as st
from ..plans import variants as va
from ..rules import ORDERS as RULES
from ..schemas import Books
from ..sources.co_located import store_ledger
from ..sources.order_books import load_order_books, order_books
from ..sources.tables import load_tables
from ..storage import new_folder, stored

# Parameters of the catalogued queries.
AS_OF = dt.date(2001, 8, 1)
SINCE = dt.date(1996, 1, 1)
LONG_SINCE = dt.date(1998, 1, 1)
YEARS = (1998, 1999, 2000)
TOP_N = 3
RECENT = dt.date(2001, 7, 1)
REPORT_MONTHS = pe.months_between(dt.date(1996, 1, 1), dt.date(2001, 12, 1))
LATE_FROM = dt.date(2000, 1, 1)
CAPITAL_PREFIX = "1"
SEARCH_WORDS = ("plier#000000001", "SUPPLIER#000000004")
ACCOUNT_WORDS = ("hot anv", "PLATE")
CUSTOMER_UNITS = (("00000001", "B"),)
PAYROLL_CODES = (*RULES.accrual_kinds, "Brand#1")


def present(frame: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Engine-neutral result: cents as DOUBLE, dates as text."""
    digits = digits or {}
    columns = []
    for field in frame.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DecimalType):
            column = mo.shown(column)
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, digits.get(field.name, 2))
        elif isinstance(kind, T.DateType) and field.name in ("month", "cutoff"):
            column = pe.month_text(column)
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def _query(build: Callable[[Books], DataFrame], **digits: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return present(build(load_order_books(spark, folder)), digits)

    run.__doc__ = build.__doc__
    return run


def _pnl(b: Books) -> DataFrame:
    return pl.pnl_long(b, RULES)


def _cells(b: Books, *roles: str) -> DataFrame:
    return pay.payroll_cells(pay.payroll_postings(b, RULES, roles or (pay.ACCRUAL, pay.LIABILITY, pay.POOL)))


def _ledger_fact(b: Books) -> DataFrame:
    fact = le.ledger_fact(b, RULES)
    return fact.select(
        "journal_id", "accounting_at", "loaded_at", "amount", "side", "account_no", "concept", "origin", "detail", "party"
    )


def ledger_co_located(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ledger from bucketed tables."""
    path = new_folder(spark, "ledger")
    books = store_ledger(load_order_books(spark, folder), path, "co_" + path.rsplit("-", 1)[-1], buckets=16)
    return present(_ledger_fact(books))


def _signed_by_account(b: Books) -> DataFrame:
    rows = le.postings(b, RULES, b["account"])
    return rows.groupBy("account_no").agg(
        F.sum(mo.signed_amount(F.col("amount"), F.col("side"))).alias("signed"),
        F.sum("amount").alias("gross"),
    )


def _origin_decode(b: Books) -> DataFrame:
    code = F.col("origin_code")
    return (
        b["journal"].withColumn("origin", cl.decode(code, RULES.origin_labels)).groupBy("origin_code", "origin").agg(F.count("*").alias("journals"))
    )


def _noise_category(b: Books) -> DataFrame:
    rows = le.postings(b, RULES, b["account"])
    category = cl.noise_category(F.col("origin_code"), F.col("detail"), RULES)
    return rows.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def _document_labels(b: Books) -> DataFrame:
    return sa.sales_lines(b, RULES).select("invoice_id", "detail").distinct()


def _fallback_share(b: Books) -> DataFrame:
    rows = pay.payroll_months(_cells(b), RULES).filter(F.col("fallback") & (F.col("kind") == "Sueldos"))
    return rows.select("unit", "month", "amount", "share")


def _fallback_apportioned(b: Books) -> DataFrame:
    rows = pay.payroll_months(_cells(b), RULES).filter(F.col("fallback") & (F.col("kind") == "Cargas Sociales"))
    return rows.select("unit", "month", "concept", "amount")


def _base_or_provision(b: Books) -> DataFrame:
    postings = pay.payroll_postings(b, RULES, (pay.ACCRUAL,))
    rows = pay.base_or_provision(postings, pay.payroll_cells(postings))
    return rows.select("unit", "kind", "subclass", "account_no", "month", "category", "amount")


def _expenses(b: Books, literal: bool = False, with_overrides: bool = True) -> DataFrame:
    rows = ex.expense_rows(b, RULES, literal, with_overrides=with_overrides)
    return rows.select("unit", "month", "concept", "account_no", "detail", "party", "amount")


def _expense_totals(b: Books, literal: bool = False) -> DataFrame:
    return _expenses(b, literal, with_overrides=False).groupBy("account_no", "concept").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount")
    )


def _flipped(b: Books) -> DataFrame:
    rows = _expenses(b)
    flipped = tx.contains(F.col("detail"), RULES.reversal_text)
    return rows.groupBy("month", flipped.alias("flipped")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def _overridden(b: Books) -> DataFrame:
    names = [o.party for o in RULES.party_overrides]
    rows = ex.detail_overrides(_expenses(b), RULES)
    hit = F.upper(F.trim("party")).isin(*names) | F.col("detail").isin(*[o.detail for o in RULES.detail_overrides])
    return rows.filter(hit).groupBy("party", "unit", "concept").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def _subclass(b: Books) -> DataFrame:
    return pay.accrual_months(b, RULES).groupBy("unit", "kind", "subclass").agg(F.sum("amount").alias("amount"))


def _movements(b: Books) -> DataFrame:
    return pl.movements(b, RULES)


def _ordered_movements(b: Books) -> DataFrame:
    return od.with_positions(pl.movements(b, RULES), ["unit", "moment", "concept", "account_no"])


def _codes(b: Books) -> DataFrame:
    rows = ex.expenses_monthly(b, RULES).filter(F.col("unit").isin(*RULES.units))
    # one row an account and concept, stored: codes and totals would read the ledger once each
    rows = stored(rows.groupBy("concept", "account_no").agg(F.sum("amount").alias("amount")), "concept-accounts")
    codes = pl.concept_codes(rows)
    totals = rows.groupBy("concept").agg(F.sum("amount").alias("amount"))
    return va.pivot_with_codes(totals, codes)


def _top(b: Books) -> DataFrame:
    return st.top_parties(st.party_months(pl.movements(b, RULES), YEARS), TOP_N).drop("position", "pnl_group")


def _party_pivot(b: Books) -> DataFrame:
    months = [m for m in REPORT_MONTHS if m[:4] in {str(y) for y in YEARS}]
    return pl.pivot_months(st.party_months(pl.movements(b, RULES), YEARS), ["unit", "concept", "party"], months)


def _statement(b: Books) -> DataFrame:
    return st.statement_rows(_pnl(b), pl.movements(b, RULES), TOP_N, YEARS)


def _closing(b: Books) -> DataFrame:
    matrix = di.date_shift_matrix(b, RULES, tuple(RULES.liability_units))
    return matrix.groupBy("load_month").agg(
        F.sum("closing").alias("closing"), F.sum("operating").alias("operating"), F.sum("n").alias("n")
    )


def _monthly_payroll(b: Books) -> DataFrame:
    return pay.payroll_hybrid(b, RULES)


def _payroll_wide(b: Books) -> DataFrame:
    rows = pay.accrual_months(b, RULES)
    names = [c for c in RULES.concept_order if c.startswith("01-") and "sin clasificar" not in c]
    concepts = [c.removeprefix("01-") for c in names]
    concept = F.when(F.col("concept").isin(*concepts), F.col("concept")).otherwise("other_concepts")
    return rows.withColumn("concept", concept).groupBy("month").pivot("concept", [*concepts, "other_concepts"]).agg(F.sum("amount"))


def _result_pivot(b: Books, literal: bool = False) -> DataFrame:
    long = va.pnl_with_result(b, RULES, LONG_SINCE, literal)
    months = [m for m in REPORT_MONTHS if m >= "1996-01"]
    wide = pl.pivot_months(long, ["scope", "account_no", "concept"], months)
    is_result = F.col("concept") == "Resultado"
    # the result of a month without rows is zero, other cells stay empty
    return wide.select(
        "scope",
        "account_no",
        "concept",
        *[F.when(is_result, F.coalesce(F.col(f"`{m}`"), F.lit(0))).otherwise(F.col(f"`{m}`")).alias(m) for m in months],
        pl.OTHER_MONTHS,
    )


def _account_canonical(b: Books) -> DataFrame:
    return b["account_policy"].select(
        F.col("account_no").alias("raw"), tx.canonical_account_no(F.col("account_no")).alias("account_no")
    )


def _last_ratio(b: Books) -> DataFrame:
    return di.last_months(pay.payroll_split(b, RULES), ["kind"], 12)


def _rule_table(b: Books) -> DataFrame:
    """Rules taken from the tables: one on every supplier's name, one on every item name in the detail."""
    number = F.col("origin_id").cast("long")
    none = F.lit(None).cast("string")
    by_party = b["origin_party"].select(
        number.alias("priority"), F.lit("party").alias("field"), F.lit(rt.EQUALS).alias("test"), F.lower("party").alias("pattern"),
        F.when(number % 3 == 0, "B").alias("unit"), F.lit("Economy ").alias("find"), F.lit("Promo ").alias("replace"), none.alias("concept"),
    )
    by_detail = b["account"].select("item_name").where(F.col("item_name").isNotNull()).distinct().select(
        F.length("item_name").cast("long").alias("priority"), F.lit("detail").alias("field"), F.lit(rt.CONTAINS).alias("test"), F.upper("item_name").alias("pattern"),
        F.when(F.col("item_name").contains("e"), "A").alias("unit"), none.alias("find"), none.alias("replace"),
        F.when(F.col("item_name") > "m", F.concat(F.lit("02-"), F.col("item_name"))).alias("concept"),
    )
    return by_party.unionByName(by_detail)


def _by_rule_table(b: Books) -> DataFrame:
    rules = _rule_table(b)
    rows = rt.apply_rules(_expenses(b, with_overrides=False), rules, "party")
    rows = rt.apply_rules(rows, rules, "detail")
    return rows.groupBy("unit", "concept").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def pnl_late_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The P&L of all lines, brought in by two batches: the later one also has lines of closed months."""
    tables = load_tables(spark, folder)
    early = F.coalesce(F.col("l_shipdate") < F.lit(LATE_FROM), F.lit(False))
    store = inc.PnlStore(spark, new_folder(spark, "pnl"), RULES).create()
    for name, part in (("early", early), ("late", ~early)):
        store.apply(order_books(tables.replaced(lineitem=tables["lineitem"].filter(part))), name)
    return present(store.pnl())


def _suppliers(name: str) -> Callable[[Books], DataFrame]:
    return lambda b: pa.supplier_outputs(b, AS_OF, RECENT)[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sales
    "sales_fact": _query(lambda b: sa.sales_fact(b, RULES).select("unit", "moment", "month", "concept", "amount", "detail", "party")),
    "sales_monthly": _query(lambda b: sa.sales_monthly(b, RULES)),
    "sales_document_label": _query(_document_labels),
    "sales_customer_units": _query(lambda b: sa.sales_monthly(b, replace(RULES, customer_units=CUSTOMER_UNITS))),
    "first_invoices": _query(lambda b: sa.first_invoices(b, RULES)),
    "new_customers": _query(lambda b: sa.new_customers(b, RULES)),
    # ledger and accounts
    "ledger_fact": _query(_ledger_fact),
    "ledger_co_located": ledger_co_located,
    "ledger_line_first": _query(
        lambda b: le.result_line_filter(le.ledger_line_first(b, RULES, LONG_SINCE), RULES).select(
            "account_no", "concept", "detail", "amount", "accounting_at"
        )
    ),
    "ledger_by_party": _query(
        lambda b: le.ledger_by_party(b, RULES, LONG_SINCE).select("account_no", "concept", "detail", "amount", "accounting_at", "party")
    ),
    "ledger_by_movement": _query(
        lambda b: le.ledger_by_party(b, RULES, LONG_SINCE, movement_first=True).groupBy("party").agg(
            F.count("*").alias("n"), F.sum("amount").alias("amount")
        )
    ),
    "account_canonical": _query(_account_canonical),
    "account_policy_selected": _query(
        lambda b: ac.policy_preferred(b["account_policy"]).filter("considered").select("account_no", "account_name")
    ),
    "account_unit_lists": _query(lambda b: ac.account_unit_lists(b, RULES)),
    "account_search": _query(lambda b: ac.account_search(b, CAPITAL_PREFIX, ACCOUNT_WORDS)),
    "origin_decode": _query(_origin_decode),
    "signed_amount": _query(_signed_by_account),
    "noise_category": _query(_noise_category),
    # payroll
    "noise_profile": _query(lambda b: di.noise_profile(b, RULES, PAYROLL_CODES)),
    "noise_summary": _query(lambda b: di.noise_summary(di.noise_profile(b, RULES, PAYROLL_CODES))),
    "payroll_base_or_provision": _query(_base_or_provision),
    "payroll_cutoff": _query(lambda b: pay.payroll_cutoff(_cells(b, pay.ACCRUAL))),
    "payroll_accrual_monthly": _query(lambda b: pay.accrual_months(b, RULES)),
    "payroll_fallback_share": _query(_fallback_share, share=6),
    "payroll_fallback_apportioned": _query(_fallback_apportioned),
    "payroll_row_apportioned": _query(lambda b: va.pool_by_row(b, RULES)),
    "payroll_account_apportioned": _query(lambda b: va.pool_by_account(b, RULES)),
    "payroll_hybrid_monthly": _query(_monthly_payroll),
    "payroll_hybrid_per_unit": _query(lambda b: pay.payroll_hybrid(b, RULES, per_unit_cutoff=True)),
    "payroll_subclass": _query(_subclass),
    "payroll_month_pivot": _query(_payroll_wide),
    "payroll_split_ratio": _query(lambda b: pay.payroll_split(b, RULES), operations_pct=1, administration_pct=1),
    "payroll_last_months": _query(_last_ratio, operations_pct=1, administration_pct=1),
    "method_reconciliation": _query(lambda b: pay.reconcile(b, RULES)),
    "fallback_months": _query(lambda b: pay.fallback_months(pay.reconcile(b, RULES))),
    # expenses
    "expenses_selected": _query(_expense_totals),
    "expenses_selected_literal": _query(lambda b: _expense_totals(b, literal=True)),
    "expenses_flipped": _query(_flipped),
    "expenses_overrides": _query(_overridden),
    "expenses_rule_table": _query(_by_rule_table),
    "expenses_monthly": _query(lambda b: ex.expenses_monthly(b, RULES)),
    "expense_codes": _query(_codes),
    "expense_pivot": _query(lambda b: va.expense_pivot(b, RULES, SINCE, REPORT_MONTHS)),
    # P&L and margin
    "movements_fact": _query(_movements),
    "movements_ordered": _query(_ordered_movements),
    "pnl_long": _query(_pnl),
    "pnl_late_batches": pnl_late_batches,
    "pnl_long_literal": _query(lambda b: pl.pnl_long(b, RULES, literal=True)),
    "pnl_pivot": _query(lambda b: pl.pnl_pivot(_pnl(b), REPORT_MONTHS)),
    "pnl_ordered": _query(lambda b: pl.pnl_ordered(_pnl(b), RULES)),
    "pnl_with_result": _query(_result_pivot),
    "pnl_with_result_literal": _query(lambda b: _result_pivot(b, literal=True)),
    "pnl_liability_method": _query(lambda b: va.pnl_liability_method(b, RULES)),
    "pnl_by_detail": _query(lambda b: va.pnl_by_detail(b, RULES)),
    "margin_monthly": _query(lambda b: ma.margin_monthly(_pnl(b), YEARS), margin_pct=4),
    "margin_total": _query(lambda b: ma.margin_total(_pnl(b), YEARS), margin_pct=4),
    "margin_chart_series": _query(lambda b: ma.chart_series(ma.margin_monthly(_pnl(b), YEARS)), value=4),
    "statement_rows": _query(_statement),
    "topn_counterparty": _query(_top),
    "counterparty_pivot": _query(_party_pivot),
    "margin_long": _query(lambda b: va.margin_long(b, RULES, LONG_SINCE)),
    "margin_from_purchases": _query(lambda b: va.margin_from_purchases(b, RULES, LONG_SINCE)),
    "month_detail": _query(lambda b: va.month_detail(b, RULES, dt.date(1999, 5, 1))),
    # parties
    "contact_report": _query(pa.contact_report),
    "contact_with_invoice": _query(pa.contacts_with_invoice),
    "supplier_report": _query(_suppliers("all")),
    "supplier_last_year": _query(_suppliers("last_year")),
    "supplier_active": _query(_suppliers("active_by_purchase")),
    "supplier_new": _query(lambda b: pa.supplier_outputs(b, AS_OF, dt.date(1995, 1, 8))["new_by_creation"]),
    "recent_customers": _query(lambda b: pa.recent_customers(b, RECENT)),
    "recent_suppliers": _query(lambda b: pa.recent_suppliers(b, RECENT)),
    "purchase_decoded": _query(
        lambda b: pu.decode_purchase(pu.purchase_rows(b)).groupBy("state_name", "voucher_name").agg(
            F.count("*").alias("n"), F.sum("price").alias("amount")
        )
    ),
    # diagnostics
    "account_activity": _query(lambda b: di.account_activity(b, SINCE)),
    "account_inventory": _query(lambda b: di.account_inventory(b, RULES, SINCE)),
    "account_inventory_totals": _query(lambda b: di.inventory_totals(di.account_inventory(b, RULES, SINCE))),
    "date_shift_matrix": _query(lambda b: di.date_shift_matrix(b, RULES, PAYROLL_CODES)),
    "closing_vs_operating": _query(_closing),
    "origin_distribution": _query(lambda b: di.origin_distribution(b, RULES, PAYROLL_CODES)),
    "unit_debit_credit": _query(lambda b: di.unit_debit_credit(b, RULES)),
    "raw_sample": _query(lambda b: di.raw_sample(b, RULES, PAYROLL_CODES, dt.date(1997, 1, 1))),
    "ledger_search": _query(lambda b: di.ledger_search(b, RULES, SEARCH_WORDS)),
    "party_search": _query(lambda b: di.party_search(b, SEARCH_WORDS)),
    "capital_accounts": _query(lambda b: di.capital_accounts(b, RULES, CAPITAL_PREFIX)),
    "asset_monthly": _query(lambda b: di.asset_monthly(b, RULES, CAPITAL_PREFIX, dt.date(1999, 1, 1), dt.date(2000, 1, 1))),
    "liability_history": _query(lambda b: di.liability_history(b, RULES)),
    "liability_raw": _query(lambda b: di.liability_raw(b, RULES, dt.date(1999, 6, 1), dt.date(1999, 9, 1))),
}
