"""Purchases: decoded states, lines, last and yearly purchases per supplier."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as cl
from ..functions import periods as pe
from ..functions import text as tx
from ..schemas import Books

PAID, CANCELLED, PENDING = 1, 2, 0
INVOICE, CREDIT_NOTE = 0, 1


def decode_purchase(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "state_name": cl.decode(F.col("state"), R.PURCHASE_STATES, R.OTHER_CODE),
            "voucher_name": cl.decode(F.col("voucher_type"), R.VOUCHER_TYPES, R.OTHER_CODE),
        }
    )


def purchase_rows(books: Books) -> DataFrame:
    """Purchase lines with their header."""
    return books["purchase_line"].join(books["purchase"], "purchase_id")


def purchase_headers(books: Books) -> DataFrame:
    """Purchases with their supplier. Lines are only read where the supplier sits on them."""
    header = books["purchase"]
    return header if "contact_id" in header.columns else purchase_rows(books)


def last_purchase(books: Books) -> DataFrame:
    return purchase_headers(books).groupBy("contact_id").agg(F.max("created_at").alias("last_purchase"))


def purchases_last_year(books: Books, as_of: dt.date) -> DataFrame:
    """Per supplier company: distinct invoices and amount in the year before ``as_of``.

    ``as_of`` is a parameter, so that the same call gives the same answer tomorrow. Amounts are
    summed per supplier and document first; counting documents is then a plain count.
    """
    rows = purchase_rows(books).filter(
        (F.col("created_at") >= pe.year_before(as_of))
        & (F.col("state") != CANCELLED)
        & (F.col("voucher_type") == INVOICE)
    )
    owners = books["supplier_contact"].select("contact_id", "company_id").join(books["supplier_company"], "company_id")
    # the document under another form than the join key: sums start map-side (see diagnostics)
    document = F.col("purchase_id").cast("string").alias("purchase_id")
    per_document = rows.groupBy("contact_id", document).agg(F.sum("price").alias("amount"))
    return (
        per_document.join(owners, "contact_id")
        .filter(F.col("company").isNotNull())
        .groupBy("company", "purchase_id")
        .agg(F.sum("amount").alias("amount"))
        .groupBy("company")
        .agg(F.count("*").alias("documents"), F.sum("amount").alias("amount"))
    )


def purchase_balance(amount: Column, voucher_type: Column) -> Column:
    """Costs negative, credit notes positive."""
    return F.when(voucher_type == CREDIT_NOTE, amount).otherwise(-amount)


def purchase_rates(books: Books, words: tuple[str, ...] | list[str]) -> DataFrame:
    """Purchases of the parties named, with the rate of their currency (null where unknown)."""
    parties = books["fiscal_party"].select("fiscal_id", "party").filter(tx.contains_any(F.col("party"), words))
    found = books["purchase"].join(parties, "fiscal_id")
    return found.join(books["fx_rate"], "rate_id", "left").select("purchase_id", "party", "created_at", "rate")
