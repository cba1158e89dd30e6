"""Sales: invoice lines to net amounts by unit and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as cl
from ..functions import money as mo
from ..functions import periods as pe
from ..functions import text as tx
from ..rules import Rules
from ..schemas import Books
from .screen import screened


def invoice_card(books: Books, rules: Rules) -> DataFrame:
    """Invoice header with its customer, branch and rate.

    The header side is joined first: it has a fraction of the rows of the line side. Cancelled
    and too-early invoices go before any join.
    """
    invoices = books["invoice"].filter(
        (F.col("status") != rules.cancelled_status) & (F.col("issued_at") >= F.lit(rules.sales_since))
    )
    return (
        invoices.join(books["customer_card"], "contact_id", "left")
        .join(books["branch"], "branch_id", "left")
        .join(books["fx_rate"], "rate_id", "left")
    )


def sales_lines(
    books: Books,
    rules: Rules,
    unit_default: str | None = None,
    with_text: bool = True,
    units: tuple[str, ...] | None = None,
) -> DataFrame:
    """Invoice lines that count as sales, with net amount, unit and month.

    Lines of excluded products and lines without a product are dropped; both product tests run
    before the join with the header, so that the largest shuffle carries fewer rows. If only some
    ``units`` are asked for, the unit is known by the header, and lines of other headers are screened off.
    """
    products = books["product"].filter(~F.col("code").isin(*rules.excluded_codes)).select("product_id")
    unit = cl.unit_of_branch(F.col("branch_no"), rules, unit_default)
    for text, owner in reversed(rules.customer_units):
        unit = F.when(tx.contains(F.col("company"), text), owner).otherwise(unit)
    lines, card = books["invoice_line"], invoice_card(books, rules)
    if units is not None:
        card = card.filter(unit.isin(*units))
        lines = screened(lines, card, "invoice_id")
    joined = lines.join(products, "product_id").join(card, "invoice_id")
    columns = [
        unit.alias("unit"),
        F.col("issued_at"),
        pe.month_of(F.col("issued_at")).alias("month"),
        mo.net_sale(F.col("price"), F.col("rate"), F.col("discount_pct"), F.col("doc_type")).alias("amount"),
    ]
    if with_text:
        label = cl.document_label(F.col("doc_type"), F.col("letter_code"), F.col("branch_no"), F.col("number"))
        columns += [F.col("company").alias("party"), label.alias("detail"), F.col("invoice_id")]
    return joined.select(*columns)


def sales_monthly(
    books: Books, rules: Rules, unit_default: str | None = None, units: tuple[str, ...] | None = None
) -> DataFrame:
    """Net sales by unit and month, as the sales rows of a P&L (exact decimal amounts)."""
    lines = sales_lines(books, rules, unit_default, with_text=False, units=units).filter(F.col("month").isNotNull())
    return (
        lines.groupBy("unit", "month")
        .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"))
        .select("unit", "month", F.concat(F.lit(R.SALES_CONCEPT), F.col("unit")).alias("concept"), "amount")
    )


def sales_fact(books: Books, rules: Rules, units: tuple[str, ...] | None = None) -> DataFrame:
    """Sales rows in the shape of the movement fact."""
    return sales_lines(books, rules, units=units).select(
        "unit",
        F.col("issued_at").alias("moment"),
        "month",
        F.concat(F.lit(R.SALES_CONCEPT), F.col("unit")).alias("concept"),
        F.lit("").alias("account_no"),
        "amount",
        "detail",
        "party",
        F.lit(R.ORIGIN_SALES).alias("source"),
        F.lit(None).cast("string").alias("origin"),
    )


def first_invoices(books: Books, rules: Rules, unit_default: str | None = None) -> DataFrame:
    """First invoice of every company: no status or date filter, smallest id on a tie.

    An aggregate instead of a ranking window: each task keeps one row per company, so a company
    with a third of all invoices is reduced before the shuffle.
    """
    headers = books["invoice"].join(
        books["customer_card"], "contact_id", "left"
    ).join(books["branch"], "branch_id", "left")
    first = F.min(F.struct("issued_at", "invoice_id", "branch_no")).alias("first")
    return (
        headers.filter(F.col("company").isNotNull() & F.col("issued_at").isNotNull())
        .groupBy("company")
        .agg(first)
        .select(
            "company",
            pe.month_of(F.col("first.issued_at")).alias("month"),
            F.col("first.invoice_id").alias("invoice_id"),
            cl.unit_of_branch(F.col("first.branch_no"), rules, unit_default).alias("unit"),
        )
    )


def new_customers(books: Books, rules: Rules) -> DataFrame:
    """Number of companies whose first invoice falls in each month and unit."""
    return first_invoices(books, rules).groupBy("month", "unit").agg(F.count("*").alias("new_customers"))
