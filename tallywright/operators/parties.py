"""Customer and supplier reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import periods as pe
from ..functions import text as tx
from ..schemas import Books
from .purchases import PAID, last_purchase, purchase_headers, purchases_last_year


def _one_per_company(frame: DataFrame, value: str) -> DataFrame:
    """One value per company (the smallest), in place of whichever row comes first."""
    return frame.groupBy("company_id").agg(F.min(value).alias(value))


def last_invoice(books: Books) -> DataFrame:
    return books["contact_invoice"].groupBy("contact_id").agg(F.max("issued_at").alias("last_invoice"))


def contact_report(books: Books) -> DataFrame:
    """Contacts by (last name, email, company) with segment, type and last invoice.

    Invoices are reduced to one row per contact before they meet the contact list, and segments
    and types to one per company: the joins are one-to-one, and the maximum is the same as over
    the many-to-many product.
    """
    joined = (
        books["contact"]
        .join(last_invoice(books), "contact_id", "left")
        .join(books["company"], "company_id", "left")
        .join(_one_per_company(books["industry"], "segment"), "company_id", "left")
        .join(_one_per_company(books["party_type"], "party_type"), "company_id", "left")
    )
    text = {c: tx.strip_control(F.col(c)) for c in ("first_name", "last_name", "email", "company", "segment", "party_type")}
    return (
        joined.groupBy("last_name", "email", "company")
        .agg(
            F.min("first_name").alias("first_name"),
            F.min("segment").alias("segment"),
            F.min("party_type").alias("party_type"),
            F.max("created_at").alias("created_at"),
            F.max("modified_at").alias("modified_at"),
            F.max("last_invoice").alias("last_invoice"),
        )
        .withColumns(text)
    )


def contacts_with_invoice(books: Books) -> DataFrame:
    return contact_report(books).filter(F.col("last_invoice").isNotNull())


def by_recency(report: DataFrame) -> DataFrame:
    """Newest contact first; company name on a tie."""
    return report.orderBy(F.col("created_at").desc_nulls_last(), F.col("company").asc_nulls_last())


def supplier_report(books: Books, as_of: dt.date) -> DataFrame:
    """Supplier companies: contact dates, last purchase, documents and amount of the last year.

    A company is a supplier if any of its types says so.
    """
    is_supplier = (
        books["supplier_type"]
        .groupBy("company_id")
        .agg(F.bool_or(F.col("party_type") == R.SUPPLIER_TYPE).alias("is_supplier"))
        .filter("is_supplier")
        .select("company_id")
    )
    companies = books["supplier_company"].join(is_supplier, "company_id")
    contacts = books["supplier_contact"].join(last_purchase(books), "contact_id", "left")
    report = (
        contacts.join(companies, "company_id")
        .groupBy("company")
        .agg(
            F.max("created_at").alias("created_at"),
            F.max("modified_at").alias("modified_at"),
            F.max("last_purchase").alias("last_purchase"),
        )
        .withColumn("party_type", F.lit(R.SUPPLIER_TYPE))
    )
    year = purchases_last_year(books, as_of)
    return (
        report.join(year, "company", "left")
        .withColumn("documents", F.coalesce("documents", F.lit(0)))
        .withColumn("amount", F.round(F.coalesce("amount", F.lit(0)), 2))
        .withColumn("company", tx.strip_control(F.col("company")))
    )


def supplier_outputs(books: Books, as_of: dt.date, since: dt.date) -> dict[str, DataFrame]:
    """The four outputs of the supplier report."""
    report = supplier_report(books, as_of)
    return {
        "new_by_creation": report.filter(F.col("created_at") >= F.lit(since)),
        "active_by_purchase": report.filter(F.col("last_purchase") >= F.lit(since)),
        "last_year": report.filter(F.col("documents") > 0).orderBy(F.col("amount").desc(), "company"),
        "all": report,
    }


def recent_customers(books: Books, since: dt.date) -> DataFrame:
    """Companies with an invoice since the date: tax id, segment, type, last invoice as text."""
    tax_ids = books["fiscal_party"].groupBy("company_id").agg(F.min("tax_id").alias("tax_id"))
    rows = (
        books["contact"]
        .select("contact_id", "company_id")
        .join(last_invoice(books), "contact_id")
        .groupBy("company_id")
        .agg(F.max("last_invoice").alias("last_invoice"))
        .join(books["company"], "company_id", "left")
        .join(tax_ids, "company_id", "left")
        .join(_one_per_company(books["industry"], "segment"), "company_id", "left")
        .join(_one_per_company(books["party_type"], "party_type"), "company_id", "left")
    )
    return (
        rows.groupBy("company")
        .agg(
            F.min("tax_id").alias("tax_id"),
            F.min("segment").alias("segment"),
            F.min("party_type").alias("party_type"),
            F.max("last_invoice").alias("latest"),
        )
        .filter(F.col("latest") >= F.lit(since))
        .select(
            tx.strip_control(F.col("company")).alias("company"),
            "tax_id",
            "segment",
            "party_type",
            pe.day_text(F.col("latest")).alias("last_invoice"),
        )
    )


def recent_suppliers(books: Books, since: dt.date) -> DataFrame:
    """Parties with a paid purchase since the date: tax id and last purchase as text."""
    last = (
        purchase_headers(books)
        .filter((F.col("created_at") >= F.lit(since)) & (F.col("state") == PAID))
        .groupBy("fiscal_id")
        .agg(F.max("created_at").alias("last_purchase"))
    )
    return (
        last.join(books["fiscal_party"].select("fiscal_id", "party", "tax_id"), "fiscal_id")
        .filter(F.col("party").isNotNull() & F.col("tax_id").isNotNull())
        .groupBy("party", "tax_id")
        .agg(F.max("last_purchase").alias("last_purchase"))
        .select(
            tx.strip_control(F.col("party")).alias("party"),
            tx.strip_control(F.col("tax_id")).alias("tax_id"),
            pe.day_text(F.col("last_purchase")).alias("last_purchase"),
        )
    )
