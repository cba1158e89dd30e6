"""P&L kept up to date: late data touch the months they belong to, and no others.

A batch of new lines is summed to cells (part, account, unit, month) and kept under its own name, so a
batch that is applied again replaces itself. The months of a batch are summed anew over all batches and
their rules decided anew: whether base or provision counts is no running choice, for a late line may bring
a base sum back to zero, and the last closed month may move either way. If it moves, the months between its
old and its new place change their method; they are recomputed too. All other months stay as they are.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as pe
from ..operators import expenses as ex
from ..operators import payroll as pay
from ..operators import sales as sa
from ..rules import Rules
from ..schemas import AMOUNT, Books
from .pnl import assemble

SALES, PAYROLL, EXPENSES = "sales", "payroll", "expenses"
KEYS = ("part", "role", "kind", "unit", "subclass", "subclass_pivot", "account_no", "concept", "month")
# sums keep the scale of a sale, so that sums of batches add up to the sum of all
EXACT = "decimal(38,8)"
CELLS = (
    "part string, role string, kind string, unit string, subclass string, subclass_pivot string, account_no string, concept string, "
    f"month date, base {EXACT}, provision {EXACT}, cell_month string, batch string"
)
# a stored month holds its rows and one marker: a month that loses all its rows is overwritten too
RESULT = "unit string, pnl_group string, concept string, month date, amount decimal(38,6), marker boolean, salaries boolean, pnl_month string"


def batch_cells(books: Books, rules: Rules) -> DataFrame:
    """Cells of the lines in ``books``: sums only, nothing is decided on them."""
    sales = sa.sales_monthly(books, rules).select(F.lit(SALES).alias("part"), "unit", "month", "concept", F.col("amount").alias("base"))
    payroll = pay.payroll_cells(pay.payroll_postings(books, rules)).drop("amount").withColumn("part", F.lit(PAYROLL))
    costs = ex.expenses_monthly(books, rules).withColumnRenamed("amount", "base").withColumn("part", F.lit(EXPENSES))
    cells = payroll.unionByName(sales, allowMissingColumns=True).unionByName(costs, allowMissingColumns=True)
    return cells.select(*KEYS, *(F.col(c).cast(EXACT).alias(c) for c in ("base", "provision")), pe.month_text(F.col("month")).alias("cell_month"))


@dataclass(frozen=True)
class PnlStore:
    """Cells and P&L in one folder on shared storage. One run at a time may write to it."""

    spark: SparkSession
    folder: str
    rules: Rules

    def create(self) -> PnlStore:
        """Empty tables; what is there is kept."""
        for name, schema, keys in (("cells", CELLS, ("cell_month", "batch")), ("pnl", RESULT, ("pnl_month",))):
            self.spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*keys).parquet(f"{self.folder}/{name}")
        return self

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def pnl(self) -> DataFrame:
        """Long P&L: unit, group, concept, month, amount."""
        return self._table("pnl", RESULT).where(~F.col("marker")).select("unit", "pnl_group", "concept", "month", "amount")

    def cells(self, months: list[str] | None = None) -> DataFrame:
        """Cells summed over all batches; of the given months only their files are read."""
        rows = self._table("cells", CELLS)
        if months is not None:
            rows = rows.where(F.col("cell_month").isin(months))
        # a sum over none stays null: a cell without base rows is not a cell whose base is zero
        return rows.groupBy(*KEYS).agg(F.sum("base").cast(EXACT).alias("base"), F.sum("provision").cast(EXACT).alias("provision"))

    def _payroll(self, months: list[str]) -> DataFrame:
        rows = self.cells(months).where(F.col("part") == PAYROLL)
        return rows.withColumn("amount", pay.counted(F.col("role"), F.col("base"), F.col("provision")))

    def _closed_months(self) -> set[str]:
        """Months with accrued salaries: at most one marker a calendar month is read."""
        rows = self._table("pnl", RESULT).where("marker AND salaries").select("pnl_month").distinct().collect()
        return {r["pnl_month"] for r in rows}

    def apply(self, books: Books, batch: str) -> list[str]:
        """Add the lines in ``books`` as ``batch``; gives the months that were computed anew.

        ``books`` holds the new lines and whole tables of everything they refer to. A change of accounts,
        policy or rules is no batch: build a new store. A run that fails may be repeated with the same
        batch name, before any other batch.
        """
        delta = batch_cells(books, self.rules).withColumn("batch", F.lit(batch))
        self._write(delta, "cells", "cell_month", "batch")
        touched = self._table("cells", CELLS).where(F.col("batch") == batch).select("cell_month").distinct()
        dirty = sorted(r["cell_month"] for r in touched.collect())
        if not dirty:
            return []
        before = self._closed_months()
        salaried = self._payroll(dirty).where(pay.is_salary_cell()).select(pe.month_text(F.col("month")).alias("m")).distinct()
        now = {r["m"] for r in salaried.collect()}
        after = (before - set(dirty)) | now
        moved = self._between(max(before, default=None), max(after, default=None))
        months = sorted({*dirty, *moved})
        # markers of months that only change their method are written again with them
        self._write(self._computed(months, max(after, default=None), after), "pnl", "pnl_month")
        return months

    def _between(self, old: str | None, new: str | None) -> list[str]:
        """Months with cells that were closed and are not, or the other way round."""
        if old == new:
            return []
        known = self._table("cells", CELLS).select("cell_month").distinct().collect()
        if old is None or new is None:
            return [r["cell_month"] for r in known]
        low, high = min(old, new), max(old, new)
        return [r["cell_month"] for r in known if low < r["cell_month"] <= high]

    def _computed(self, months: list[str], cutoff: str | None, salaried: set[str]) -> DataFrame:
        last = F.lit(dt.date.fromisoformat(f"{cutoff}-01") if cutoff else None).cast("date")
        payroll = pay.payroll_months(self._payroll(months), self.rules, cutoff=last).groupBy("unit", "month", "concept").agg(F.sum("amount").alias("amount"))
        cells = self.cells(months)
        amount = F.col("base").cast(AMOUNT).alias("amount")
        sales = cells.where(F.col("part") == SALES).select("unit", "month", "concept", amount)
        costs = cells.where(F.col("part") == EXPENSES).groupBy("unit", "month", "concept").agg(F.sum("base").alias("base")).select("unit", "month", "concept", amount)
        rows = assemble(sales, payroll, costs, self.rules)
        rows = rows.withColumn("amount", F.col("amount").cast("decimal(38,6)")).withColumns({"marker": F.lit(False), "pnl_month": pe.month_text(F.col("month"))})
        markers = self.spark.createDataFrame([(True, m in salaried, m) for m in months], "marker boolean, salaries boolean, pnl_month string")
        return rows.unionByName(markers, allowMissingColumns=True)

    def _write(self, rows: DataFrame, name: str, *keys: str) -> None:
        """Only the partitions that rows fall into are replaced."""
        ready = rows.hint("rebalance", *(F.col(k) for k in keys))
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.folder}/{name}")
