"""Money: exact sums, signs, display formats.

Amounts are DECIMAL(18,2) before any sum: one rule tests a sum for exactly zero, and a
floating sum depends on the order of its terms. Results leave as DOUBLE, rounded while still
decimal, so that the rounding does not depend on binary representation either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY
from . import text as tx


def money(value: Column) -> Column:
    return value.cast(MONEY)


def shown(total: Column) -> Column:
    """Reported amount: decimal total, rounded to cents, as DOUBLE."""
    return F.round(total, 2).cast("double")


def signed_amount(amount: Column, side: Column) -> Column:
    """Debit (0) positive, credit (1) negative, any other side null."""
    return F.when(side == 0, amount).when(side == 1, -amount)


def net_sale(price: Column, rate: Column, discount_pct: Column, doc_type: Column) -> Column:
    """Price x rate x (1 - discount/100), negative on a credit note.

    A missing rate gives a null amount, which sums ignore. A null type counts as an invoice.
    """
    factor = (1 - discount_pct / 100).cast("decimal(8,6)")
    net = price * rate * factor
    return F.when(doc_type == 1, -net).otherwise(net)


def flip_reversals(amount: Column, detail: Column, pattern: str) -> Column:
    """Credit notes and cancellations are booked positive; their text gives them away."""
    return F.when(tx.contains(detail, pattern), -amount).otherwise(amount)


def thousands(value: Column) -> Column:
    """``1.234.567``"""
    return F.translate(F.format_number(value.cast("bigint"), 0), ",", ".")


def millions(value: Column) -> Column:
    """Value / 1e6, one decimal, local separators: ``1.234,5``"""
    return F.translate(F.format_number(value.cast("double") / 1e6, 1), ",.", ".,")


def peso_millions(value: Column) -> Column:
    """``$1.234,5M``, with the minus sign in front of the currency sign."""
    return F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), millions(F.abs(value)), F.lit("M"))


def margin_pct(margin: Column, sales: Column) -> Column:
    """Margin over sales in percent; null where sales are zero or absent."""
    return F.try_divide(margin.cast("double"), F.nullif(sales.cast("double"), F.lit(0.0))) * 100
