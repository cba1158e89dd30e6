"""Dates and periods. A month is a DATE (its first day); ``yyyy-MM`` text is for labels only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import MONTH_NAMES


def month_of(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "month")


def month_text(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def month_or_dash(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit("-"))


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "dd/MM/yyyy")


def parse_moment(text: Column) -> Column:
    """Lenient parse: null where the text is no date."""
    return F.try_to_timestamp(text)


def month_name(month: Column) -> Column:
    """Short Spanish month and year, as on the chart axis: ``Ene 2024``."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat_ws(" ", F.element_at(names, F.month(month)), F.year(month).cast("string"))


def in_years(month: Column, years: tuple[int, ...] | list[int]) -> Column:
    """Year multi-select; selecting nothing keeps nothing."""
    return F.year(month).isin(list(years)) if years else F.lit(False)


def period_label(years: tuple[int, ...] | list[int]) -> str:
    return f"{min(years)} – {max(years)}" if years else ""


def year_before(as_of: dt.date) -> Column:
    return F.add_months(F.lit(as_of), -12)


def months_between(first: dt.date, last: dt.date) -> list[str]:
    """Calendar of month labels from ``first`` to ``last``, both included."""
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [f"{first.year + (first.month - 1 + i) // 12}-{(first.month - 1 + i) % 12 + 1:02d}" for i in range(count)]
