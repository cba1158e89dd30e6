"""Statement of results: group, concept and counterparty lines, margin lines, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import money as mo
from ..functions import periods as pe
from ..functions import text as tx


def party_months(fact: DataFrame, years: tuple[int, ...] | None = None) -> DataFrame:
    """Amount by unit, group, concept, party and month. Rows without a party are left out."""
    rows = fact if years is None else fact.filter(pe.in_years(F.col("month"), years))
    return (
        rows.filter(F.col("party").isNotNull())
        .groupBy("unit", "pnl_group", "concept", "party", "month")
        .agg(F.sum("amount").alias("amount"))
    )


def party_totals(by_month: DataFrame) -> DataFrame:
    """Sum of absolute monthly amounts of every party: one number each, whatever months it has."""
    return by_month.groupBy("unit", "pnl_group", "concept", "party").agg(F.sum(F.abs("amount")).alias("total"))


def top_parties(by_month: DataFrame, n: int) -> DataFrame:
    """The ``n`` parties per unit and concept with the largest sum of absolute monthly amounts.

    Ties go by name. Only totals are ranked, and the rank filter reaches below the shuffle (window group
    limit): a task holds and sends at most ``n`` parties per concept, however many parties and months a
    concept has.
    """
    order = Window.partitionBy("unit", "concept").orderBy(F.col("total").desc(), F.col("party"))
    return party_totals(by_month).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def months_of(best: DataFrame, by_month: DataFrame) -> DataFrame:
    """Monthly amounts of the chosen parties alone: the few winners are joined back to the months."""
    keys = ["unit", "pnl_group", "concept", "party"]
    return by_month.join(best.select(*keys), keys, "left_semi")


def statement_rows(
    pnl: DataFrame, fact: DataFrame | None = None, n: int = 10, years: tuple[int, ...] | None = None
) -> DataFrame:
    """Lines of the statement as rows: unit, section, level, concept, party, label, month, amount.

    Level 0 is a group total, 1 a concept, 2 a counterparty, 3 the margin, 4 the margin percent.
    Levels 0, 1, 3 and 4 come from one pass over the P&L (grouping sets).
    """
    rows = pnl if years is None else pnl.filter(pe.in_years(F.col("month"), years))
    keys = ["unit", "month", "pnl_group", "concept"]

    def part(group: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("pnl_group") == group, F.col("amount"))), F.lit(0))

    sets = rows.groupingSets([keys, keys[:3], keys[:2]], *keys).agg(
        F.grouping_id().alias("depth"),
        F.sum("amount").alias("amount"),
        part(R.GROUP_SALES).alias("sales"),
        part(R.GROUP_PAYROLL).alias("payroll"),
        part(R.GROUP_EXPENSES).alias("expenses"),
    )
    margin = F.col("sales") - F.col("payroll") - F.col("expenses")
    percent = mo.margin_pct(margin, F.col("sales"))
    group_label = F.regexp_replace("pnl_group", "^[0-9][.]", "")
    # grouping id: 0 = all keys, 1 = without concept, 3 = unit and month only
    line = (
        F.when(F.col("depth") == 0, F.array(_line(1, tx.concept_label(F.col("concept")), F.col("amount"))))
        .when(F.col("depth") == 1, F.array(_line(0, group_label, F.col("amount"))))
        .otherwise(F.array(_line(3, F.lit(R.MARGIN_LABEL), margin), _line(4, F.lit(R.MARGIN_PCT_LABEL), percent)))
    )
    lines = sets.withColumn("line", F.explode(line)).select(
        "unit",
        F.coalesce("pnl_group", F.lit(R.MARGIN_SECTION)).alias("section"),
        F.col("line.level").alias("level"),
        "concept",
        F.lit(None).cast("string").alias("party"),
        F.col("line.label").alias("label"),
        "month",
        F.col("line.amount").alias("amount"),
    )
    if fact is None:
        return lines
    # only concepts that have a line of their own are opened up
    shown = rows.select("unit", "concept").distinct()
    by_month = party_months(fact, years)
    best = top_parties(by_month, n).join(shown, ["unit", "concept"], "left_semi")
    details = months_of(best, by_month).select(
        "unit",
        F.col("pnl_group").alias("section"),
        F.lit(2).alias("level"),
        "concept",
        "party",
        tx.short_label(F.col("party")).alias("label"),
        "month",
        "amount",
    )
    return lines.unionByName(details)


def _line(level: int, label: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), label.alias("label"), amount.cast("decimal(38,6)").alias("amount")
    )
