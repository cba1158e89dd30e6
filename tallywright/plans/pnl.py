"""P&L by unit and month: movement fact, long form, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import periods as pe
from ..operators import expenses as ex
from ..operators import payroll as pay
from ..operators import sales as sa
from ..rules import Rules
from ..schemas import AMOUNT, Books

OTHER_MONTHS = "other_months"
FACT_COLUMNS = ("unit", "moment", "month", "concept", "account_no", "amount", "detail", "party", "source", "origin")


def movements(books: Books, rules: Rules) -> DataFrame:
    """Transaction fact of the known units: sales, payroll and expense rows, with group.

    No global sort: a consumer that wants an order asks for it, and the sink sorts inside its
    partitions.
    """
    sales = sa.sales_fact(books, rules, rules.units).withColumn("amount", F.col("amount").cast(AMOUNT))
    costs = ex.expense_rows(books, rules).withColumn("amount", F.col("amount").cast(AMOUNT))
    fact = (
        sales.unionByName(pay.payroll_fact(books, rules), allowMissingColumns=True)
        .unionByName(costs)
        .filter(F.col("unit").isin(*rules.units))
    )
    fact = ex.detail_overrides(fact, rules).withColumn("concept", cl.with_order_prefix(F.col("concept")))
    return fact.select(cl.pnl_group(F.col("concept")).alias("pnl_group"), *FACT_COLUMNS)


def pnl_long(
    books: Books, rules: Rules, literal: bool = False, per_unit_cutoff: bool = False
) -> DataFrame:
    """Long P&L: unit, group, concept, month, amount.

    The three parts are summed before they are put together, so the union and the last
    group-by only see monthly totals. ``literal`` counts an account that meets both expense
    tests twice and leaves the detail overrides to the fact.
    """
    sales = sa.sales_monthly(books, rules, units=rules.units).select(
        "unit", "month", "concept", F.col("amount").cast(AMOUNT).alias("amount")
    )
    payroll = pay.payroll_hybrid(books, rules, per_unit_cutoff).select("unit", "month", "concept", "amount")
    costs = ex.expenses_monthly(books, rules, literal, consistent=not literal).select(
        "unit", "month", "concept", F.col("amount").cast(AMOUNT).alias("amount")
    )
    return assemble(sales, payroll, costs, rules)


def assemble(sales: DataFrame, payroll: DataFrame, costs: DataFrame, rules: Rules) -> DataFrame:
    """Long P&L of the monthly rows (unit, month, concept, amount) of its three parts."""
    rows = sales.unionByName(payroll).unionByName(costs).filter(F.col("unit").isin(*rules.units))
    rows = rows.withColumn("concept", cl.with_order_prefix(F.col("concept")))
    # month and concept are never null here; testing them again would only set the payroll part
    # apart from the cutoff subquery that shares its shuffle
    return (
        rows.groupBy("unit", "concept", "month")
        .agg(F.sum("amount").alias("amount"))
        .select("unit", cl.pnl_group(F.col("concept")).alias("pnl_group"), "concept", "month", "amount")
    )


def month_labels(frame: DataFrame) -> list[str]:
    """Calendar from the first to the last month of ``frame``: one aggregate row is collected."""
    first, last = frame.agg(F.min("month"), F.max("month")).first()
    return pe.months_between(first, last) if first is not None else []


def pivot_months(frame: DataFrame, keys: list[str], months: list[str] | None = None) -> DataFrame:
    """One column per month label; a month without rows is null.

    With the month list given, no job runs before the pivot itself, and rows of months outside the
    list are summed in ``other_months``.

    A row of the pivot is held at full width while it fills, so keys are dealt to all the shuffle's
    partitions, by number: joined into a few large ones, their short rows would widen in few tasks.
    """
    label = pe.month_text(F.col("month"))
    columns = month_labels(frame) if months is None else [*months, OTHER_MONTHS]
    if months is not None:
        label = F.when(label.isin(*months), label).otherwise(OTHER_MONTHS) if months else F.lit(OTHER_MONTHS)
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.withColumn("month_label", label).repartition(parts, *keys)
    return dealt.groupBy(*keys).pivot("month_label", columns).agg(F.sum("amount"))


def pnl_pivot(pnl: DataFrame, months: list[str] | None = None) -> DataFrame:
    return pivot_months(pnl, ["unit", "pnl_group", "concept"], months)


def pnl_ordered(pnl: DataFrame, rules: Rules, order: tuple[str, ...] | None = None) -> DataFrame:
    """Custom concept order first, the rest by name after it."""
    rank = cl.concept_rank(F.col("concept"), rules.concept_order if order is None else order)
    return pnl.withColumn("concept_rank", rank).orderBy("unit", "concept_rank", "concept", "month")


def concept_codes(pnl_rows: DataFrame) -> DataFrame:
    """Distinct (concept, account) pairs behind a P&L."""
    return pnl_rows.select("concept", "account_no").distinct()
