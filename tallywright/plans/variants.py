"""Older margin products, kept for parity: long format, purchases, pivots, liability method."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as cl
from ..functions import periods as pe
from ..functions import text as tx
from ..operators import apportion as ap
from ..operators import expenses as ex
from ..operators import ledger as le
from ..operators import purchases as pu
from ..operators import sales as sa
from ..rules import Rules
from ..schemas import AMOUNT, Books
from .pnl import pivot_months


def _label_unit(concept, rules: Rules):
    return F.when(tx.contains(concept, rules.label_unit_pattern), rules.unit_a).otherwise(rules.unit_b)


def _long_accounts(books: Books, rules: Rules) -> DataFrame:
    accounts = books["account"].filter(F.col("class_code").isin(*rules.long_codes))
    return accounts.withColumn("concept", tx.title_case(F.col("account_name")))


def margin_long(books: Books, rules: Rules, since: dt.date) -> DataFrame:
    """Long margin: monthly sales and payroll postings with signed balance and category.

    Branches without a unit count as the first unit. Categories come from the account list, so
    they join the accounts, not the postings.
    """
    sales = sa.sales_monthly(books, rules, unit_default=rules.unit_a).select(
        "unit",
        "month",
        "concept",
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.col("amount").cast(AMOUNT).alias("balance"),
    )
    accounts = _long_accounts(books, rules).join(books["account_category"], "category_key", "left")
    rows = le.result_line_filter(le.postings(books, rules, accounts, since, by_accounting_date=True), rules)
    costs = rows.select(
        _label_unit(F.col("concept"), rules).alias("unit"),
        pe.month_of(F.col("accounting_at")).alias("month"),
        pe.day_text(F.col("accounting_at")).alias("day"),
        "account_no",
        "concept",
        F.col("detail").alias("voucher"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        (-F.col("amount")).cast(AMOUNT).alias("balance"),
        "category",
    )
    both = costs.unionByName(sales, allowMissingColumns=True)
    return both.withColumn("category", F.coalesce("category", F.lit(R.DEFAULT_CATEGORY))).withColumn(
        "concept_rank", cl.concept_rank(F.col("concept"), rules.concept_order_old)
    )


def margin_from_purchases(books: Books, rules: Rules, since: dt.date) -> DataFrame:
    """Long margin whose costs are paid purchases and payroll postings."""
    sales = sa.sales_monthly(books, rules, unit_default=rules.unit_a).select(
        "unit",
        "month",
        "concept",
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.col("amount").cast(AMOUNT).alias("balance"),
        F.lit(R.DEFAULT_CATEGORY).alias("product_code"),
    )
    rows = le.postings(books, rules, _long_accounts(books, rules), since, by_accounting_date=True)
    payroll = rows.select(
        _label_unit(F.col("concept"), rules).alias("unit"),
        pe.month_of(F.col("accounting_at")).alias("month"),
        pe.day_text(F.col("accounting_at")).alias("day"),
        "concept",
        tx.title_case(F.col("detail")).alias("product"),
        F.col("account_no").alias("number"),
        F.col("amount").cast(AMOUNT).alias("amount"),
        (-F.col("amount")).cast(AMOUNT).alias("balance"),
        F.lit(R.PAYROLL_CATEGORY).alias("product_code"),
    )
    products = books["product"].select(
        "product_id", "code", "product", tx.title_case(F.col("product_kind")).alias("product_kind")
    )
    paid = (
        pu.purchase_rows(books)
        .filter((F.col("created_at") >= F.lit(since)) & (F.col("state") == pu.PAID))
        .join(books["fiscal_party"].select("fiscal_id", "party"), "fiscal_id", "left")
        .join(products, "product_id", "left")
    )
    costs = pu.decode_purchase(paid).select(
        pe.month_of(F.col("created_at")).alias("month"),
        pe.day_text(F.col("created_at")).alias("day"),
        F.col("product_kind").alias("concept"),
        "product",
        F.col("number").cast("string").alias("number"),
        F.col("price").cast(AMOUNT).alias("amount"),
        pu.purchase_balance(F.col("price"), F.col("voucher_type")).cast(AMOUNT).alias("balance"),
        F.col("code").alias("product_code"),
        "party",
        "state_name",
        "voucher_name",
    )
    both = costs.unionByName(payroll, allowMissingColumns=True).unionByName(sales, allowMissingColumns=True)
    return both.withColumn("concept_rank", cl.concept_rank(F.col("concept"), rules.concept_order_old))


def expense_pivot(books: Books, rules: Rules, since: dt.date, months: list[str] | None = None) -> DataFrame:
    """Every account by load month, no selection at all."""
    accounts = le.account_names(books["account"]).filter(
        F.col("account_no").isNotNull() & F.col("concept").isNotNull()
    )
    monthly = le.account_months(books, rules, accounts, since).select("account_no", "concept", "month", "amount")
    return pivot_months(monthly, ["account_no", "concept"], months)


def pnl_with_result(
    books: Books, rules: Rules, since: dt.date, literal: bool = False
) -> DataFrame:
    """Full P&L in three scopes (all, each unit by label), each with its result row.

    Result = sales rows minus the others. ``literal`` takes the first two rows of a scope for
    sales, whatever they are.
    """
    sales = sa.sales_monthly(books, rules).select(
        F.lit("").alias("account_no"), "concept", "month", F.col("amount").cast(AMOUNT).alias("amount")
    )
    rows = le.result_line_filter(le.ledger_line_first(books, rules, since), rules)
    costs = (
        rows.groupBy("account_no", "concept", pe.month_of(F.col("accounting_at")).alias("month"))
        .agg(F.sum("amount").cast(AMOUNT).alias("amount"))
        .select("account_no", "concept", "month", "amount")
    )
    all_rows = sales.unionByName(costs)
    unit = F.when(tx.contains(F.col("concept"), rules.label_pattern), rules.unit_a).otherwise(rules.unit_b)
    scoped = all_rows.withColumn("scope", F.explode(F.array(F.lit(R.SCOPE_ALL), unit)))
    if literal:
        order = Window.partitionBy("scope").orderBy(
            cl.concept_rank(F.col("concept"), rules.concept_order_old), "concept", "account_no"
        )
        keys = scoped.select("scope", "concept", "account_no").distinct()
        lead = keys.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= 2)
        marked = scoped.join(lead.withColumn("is_sales", F.lit(True)), ["scope", "concept", "account_no"], "left")
        is_sales = F.coalesce("is_sales", F.lit(False))
    else:
        marked = scoped
        is_sales = F.col("concept").startswith(R.SALES_CONCEPT)
    result = (
        marked.groupBy("scope", "month")
        .agg(F.sum(F.when(is_sales, F.col("amount")).otherwise(-F.col("amount"))).alias("amount"))
        .select("scope", F.lit("").alias("account_no"), F.lit(R.RESULT_LABEL).alias("concept"), "month", "amount")
    )
    return scoped.select("scope", "account_no", "concept", "month", "amount").unionByName(result)


def month_detail(books: Books, rules: Rules, month: dt.date, account_no: str | None = None) -> DataFrame:
    """Drill-down: result-account postings of one accounting month and the first unit's label."""
    rows = le.result_line_filter(le.ledger_line_first(books, rules, month), rules)
    rows = rows.filter(pe.month_of(F.col("accounting_at")) == F.lit(month))
    rows = rows.filter(tx.contains(F.col("concept"), rules.label_pattern))
    if account_no is not None:
        rows = rows.filter(F.col("account_no") == account_no)
    return rows.select(
        "account_no",
        "concept",
        "detail",
        F.col("amount").cast(AMOUNT).alias("amount"),
        pe.day_text(F.col("accounting_at")).alias("day"),
    )


# ── liability method ────────────────────────────────────────────────────────────────────────


def _liability_rows(books: Books, rules: Rules) -> DataFrame:
    """Debit postings of the salary liability accounts, with unit and month."""
    accounts = le.account_names(books["account"].filter(F.col("class_code").isin(*rules.liability_units)))
    accounts = accounts.withColumn("unit", cl.decode(F.col("class_code"), rules.liability_units))
    rows = le.postings(books, rules, accounts).filter(F.col("side") == 0)
    return rows.withColumn("month", pe.month_of(F.col("loaded_at")))


def liability_shares(books: Books, rules: Rules) -> DataFrame:
    monthly = _liability_rows(books, rules).groupBy("unit", "month").agg(F.sum("amount").alias("amount"))
    return ap.month_shares(monthly)


def _pool_rows(books: Books, rules: Rules) -> DataFrame:
    """Charges (debit) and union dues (both sides), marked by kind."""
    accounts = le.account_names(books["account"].filter(F.col("class_code").isin(*rules.all_pool_codes)))
    kind = F.when(F.col("class_code").isin(*rules.pool_codes), R.CHARGES).otherwise(R.UNION_DUES)
    rows = le.postings(books, rules, accounts.withColumn("kind", kind))
    return rows.filter((F.col("kind") == R.UNION_DUES) | (F.col("side") == 0)).withColumn(
        "month", pe.month_of(F.col("loaded_at"))
    )


def _pool_concept():
    return F.concat(F.col("kind"), F.lit(" - "), F.col("unit"))


def pool_by_row(books: Books, rules: Rules) -> DataFrame:
    """Row-level apportionment: every pool posting split over the units of its month."""
    rows = _pool_rows(books, rules).select(
        "kind", F.col("loaded_at").alias("moment"), "month", "account_no", F.col("concept").alias("detail"), "amount"
    )
    return ap.apportion_rows(rows, liability_shares(books, rules)).select(
        "unit", "moment", "month", _pool_concept().alias("concept"), "account_no", "amount", "detail",
        F.col("kind").alias("source"),
    )


def pool_by_account(books: Books, rules: Rules) -> DataFrame:
    """Apportionment per pool account, detail text and month."""
    titled = _by_detail(_pool_rows(books, rules), ["kind", "account_no", "month"])
    return ap.apportion_rows(titled, liability_shares(books, rules)).select(
        "unit", "month", _pool_concept().alias("concept"), "detail", "account_no", "amount"
    )


def pnl_liability_method(books: Books, rules: Rules, with_prefix: bool = True) -> DataFrame:
    """P&L with salaries by liability account and union dues as their own line."""
    salaries_rows = _liability_rows(books, rules)
    salaries = salaries_rows.groupBy("unit", "concept", "month").agg(F.sum("amount").cast(AMOUNT).alias("amount"))
    shares = liability_shares(books, rules)
    pools = _pool_rows(books, rules).groupBy("kind", "month").agg(F.sum("amount").alias("amount"))
    charges = ap.apportion_rows(pools, shares).select("unit", _pool_concept().alias("concept"), "month", "amount")
    sales = sa.sales_monthly(books, rules).select("unit", "concept", "month", F.col("amount").cast(AMOUNT).alias("amount"))
    costs = ex.expenses_monthly(books, rules, consistent=False).select(
        "unit", "concept", "month", F.col("amount").cast(AMOUNT).alias("amount")
    )
    rows = sales.unionByName(salaries).unionByName(charges).unionByName(costs).filter(F.col("unit").isin(*rules.units))
    if with_prefix:
        rows = rows.withColumn("concept", cl.with_order_prefix(F.col("concept"), R.PAYROLL_WORDS_OLD))
    return (
        rows.groupBy("unit", "concept", "month")
        .agg(F.sum("amount").alias("amount"))
        .select("unit", cl.pnl_group(F.col("concept")).alias("pnl_group"), "concept", "month", "amount")
    )


def pnl_by_detail(books: Books, rules: Rules) -> DataFrame:
    """Long P&L down to the journal text: unit, month, concept, detail, account, amount.

    Salaries carry their text as the concept; rows without a text show a dash.
    """
    sales = sa.sales_monthly(books, rules).select("unit", "month", "concept", F.col("amount").cast(AMOUNT).alias("amount"))
    salaries = _by_detail(_liability_rows(books, rules), ["unit", "month", "account_no"])
    salaries = salaries.filter(F.col("detail").isNotNull()).select(
        "unit", "month", F.col("detail").alias("concept"), "account_no", "amount"
    )
    pools = pool_by_account(books, rules)
    costs = _by_detail(ex.expense_rows(books, rules, with_party=False), ["unit", "month", "account_no", "concept"])
    costs = costs.filter(F.col("detail").isNotNull())
    rows = sales
    for part in (salaries, pools, costs):
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.filter(F.col("unit").isin(*rules.units)).withColumn("detail", F.coalesce("detail", F.lit("-")))


def _by_detail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by title-cased text. Raw texts are summed first, so that the casing (slow, outside
    generated code) runs once per distinct text and not once per row."""
    raw = rows.groupBy(*keys, "detail").agg(F.sum("amount").alias("amount"))
    titled = raw.withColumn("detail", tx.title_case(F.trim("detail")))
    return titled.groupBy(*keys, "detail").agg(F.sum("amount").cast(AMOUNT).alias("amount"))


def pivot_with_codes(pivot: DataFrame, codes: DataFrame) -> DataFrame:
    """Pivot with the account codes behind each concept; a concept with n codes gives n rows."""
    return pivot.join(codes, "concept")
