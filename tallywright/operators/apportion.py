"""Apportionment: shares of a month's total, and pools split by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import AMOUNT


def month_shares(amounts: DataFrame) -> DataFrame:
    """Share of each unit in its month's total. ``amounts``: one row per (unit, month).

    The window runs on monthly sums, a few rows per month. A zero total gives a null share.
    """
    total = F.sum("amount").over(Window.partitionBy("month"))
    return amounts.withColumn("share", F.try_divide(F.col("amount").cast("double"), total.cast("double"))).select(
        "unit", "month", "share"
    )


def apportion_total(shares: DataFrame, pool: DataFrame) -> DataFrame:
    """Monthly pool (month, pool) by share: months without shares vanish, no pool gives zero."""
    joined = shares.join(pool, "month", "left")
    amount = (F.coalesce(F.col("pool").cast("double"), F.lit(0.0)) * F.col("share")).cast(AMOUNT)
    return joined.select("unit", "month", "share", amount.alias("amount"))


def apportion_rows(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Every pool row once per unit of its month, with its part of the amount.

    The fan-out is the product wanted: one part per unit. A row of a month without shares stays,
    with a null unit. The share table has at most units x calendar months rows, however large
    the ledger, so sending it to every task is safe, and no pool row moves.
    """
    parts = F.broadcast(shares)
    return rows.join(parts, "month", "left").withColumn(
        "amount", (F.col("amount").cast("double") * F.col("share")).cast(AMOUNT)
    )
