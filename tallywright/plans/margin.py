"""Margin figures for a dashboard: totals per group, margin, margin percent, chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import money as mo
from ..functions import periods as pe


def _group_sum(group: str) -> Column:
    """Group total; a group without rows is zero."""
    return F.coalesce(F.sum(F.when(F.col("pnl_group") == group, F.col("amount"))), F.lit(0))


def _group_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    totals = rows.groupBy(*keys).agg(
        _group_sum(R.GROUP_SALES).alias("sales"),
        _group_sum(R.GROUP_PAYROLL).alias("payroll"),
        _group_sum(R.GROUP_EXPENSES).alias("expenses"),
    )
    return totals.withColumn("margin", F.col("sales") - F.col("payroll") - F.col("expenses"))


def margin_monthly(pnl: DataFrame, years: tuple[int, ...] | None = None) -> DataFrame:
    """Per unit and month: sales, payroll, expenses, margin, margin percent (null without sales)."""
    rows = pnl if years is None else pnl.filter(pe.in_years(F.col("month"), years))
    totals = _group_totals(rows, ["unit", "month"])
    return totals.withColumn("margin_pct", mo.margin_pct(F.col("margin"), F.col("sales")))


def margin_total(pnl: DataFrame, years: tuple[int, ...] | None = None) -> DataFrame:
    """Per unit over the whole selection, with the figures as shown on the cards.

    Over a period without sales the percentage is zero, not null.
    """
    rows = pnl if years is None else pnl.filter(pe.in_years(F.col("month"), years))
    totals = _group_totals(rows, ["unit"])
    return totals.withColumn("costs", F.col("payroll") + F.col("expenses")).withColumns(
        {
            "margin_pct": F.coalesce(mo.margin_pct(F.col("margin"), F.col("sales")), F.lit(0.0)),
            "sales_text": mo.peso_millions(F.col("sales")),
            "costs_text": mo.peso_millions(F.col("costs")),
            "margin_text": mo.peso_millions(F.col("margin")),
        }
    )


def chart_series(monthly: DataFrame) -> DataFrame:
    """Long series for the chart: unit, series, month, label, value (money in millions)."""
    series = {
        "Ventas": F.col("sales").cast("double") / 1e6,
        "RRHH": F.col("payroll").cast("double") / 1e6,
        "Egresos": F.col("expenses").cast("double") / 1e6,
        "Margen": F.col("margin").cast("double") / 1e6,
        R.MARGIN_PCT_LABEL: F.col("margin_pct"),
    }
    points = F.array(*[F.struct(F.lit(n).alias("series"), v.alias("value")) for n, v in series.items()])
    return monthly.select("unit", "month", pe.month_name(F.col("month")).alias("label"), F.explode(points).alias("point")).select(
        "unit", "month", "label", "point.series", "point.value"
    )
