"""Side files: chart-of-accounts policy, categories, diagnostic exports, stored reports."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify as cl
from ..functions import periods as pd
from ..functions import text as tx
from ..schemas import ACCOUNT_CATEGORY, ACCOUNT_POLICY
from ..storage import stored

MONTH_COLUMN = re.compile(r"^\d{4}-\d{2}$")


def load_account_policy(spark: SparkSession, path: str) -> DataFrame:
    """Chart-of-accounts export (CSV). Its ten columns are named by position, not by header."""
    return spark.read.csv(path, schema=ACCOUNT_POLICY, header=True, enforceSchema=True)


def load_category(spark: SparkSession, path: str) -> DataFrame:
    """Account number to category, two columns by position."""
    raw = spark.read.csv(path, schema=ACCOUNT_CATEGORY, header=True, enforceSchema=True)
    return raw.withColumn("category_key", tx.canonical_account_no(F.col("category_key")))


def load_export_csv(
    spark: SparkSession,
    path: str,
    months: tuple[str, ...] = (),
    moments: tuple[str, ...] = (),
    decimals: tuple[str, ...] = (),
    integers: tuple[str, ...] = (),
) -> DataFrame:
    """Diagnostic export: byte-order mark in the header, ``b'…'`` months, dates that may not parse."""
    raw = spark.read.csv(path, header=True, multiLine=False)
    frame = raw.toDF(*[name.lstrip("﻿") for name in raw.columns])
    changes = {name: tx.strip_bytes_mark(F.col(name)) for name in months}
    changes |= {name: pd.parse_moment(F.col(name)) for name in moments}
    changes |= {name: F.col(name).try_cast("decimal(18,2)") for name in decimals}
    changes |= {name: F.col(name).try_cast("bigint") for name in integers}
    return frame.withColumns(changes)


CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class CheckedRows:
    """Rows that parse whole, the lines that do not with their reasons, and how many there are of each."""

    rows: DataFrame
    rejects: DataFrame
    lines: int
    kept: int
    reasons: dict[str, int]


def _cell_tests(names: list[str], months, moments, decimals, integers) -> dict[str, tuple[Column, Column]]:
    """Value of every typed column, and whether its text is there but is no such value."""
    tests = {}
    for name in names:
        text = F.trim(F.col(name))
        there = text.isNotNull() & (text != "")
        if name in months:
            value = tx.strip_bytes_mark(text)
            tests[name] = (value, there & ~value.rlike(MONTH_COLUMN.pattern))
        elif name in moments:
            tests[name] = (pd.parse_moment(text), there & pd.parse_moment(text).isNull())
        elif name in decimals:
            # a value with more decimals than money has is no value of ours: it would be rounded
            value = text.try_cast("decimal(18,2)")
            tests[name] = (value, there & (value.isNull() | (value != text.try_cast("decimal(38,12)"))))
        elif name in integers:
            tests[name] = (text.try_cast("bigint"), there & text.try_cast("bigint").isNull())
    return tests


def load_checked_csv(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...],
    *,
    months: tuple[str, ...] = (),
    moments: tuple[str, ...] = (),
    decimals: tuple[str, ...] = (),
    integers: tuple[str, ...] = (),
) -> CheckedRows:
    """An export read line by line, nothing turned into null unseen.

    A line is kept if it has exactly ``columns`` and every typed cell is empty or parses. Any other line goes
    to the rejects, whole, with all its reasons: ``record`` for a line that does not fit the columns, else
    the names of the cells. Rows and rejects together are the lines behind the header. Both are stored, and
    counted by the very job that stores them.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*columns, CORRUPT)])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    tests = _cell_tests(list(columns), months, moments, decimals, integers)
    broken = F.col(CORRUPT).isNotNull()
    cells = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, (_, bad) in tests.items())).cast("array<string>"))
    why = F.when(broken, F.array(F.lit("record"))).otherwise(cells)
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*columns)))
    seen = Observation("lines")
    counts = [F.count_if(F.array_contains("_why", reason)).alias(f"n_{i}") for i, reason in enumerate(("record", *tests))]
    judged = raw.withColumns({"_why": why, "_line": line}).observe(seen, F.count(F.lit(1)).alias("lines"), F.count_if(F.size("_why") == 0).alias("kept"), *counts)
    values = [tests[name][0].alias(name) if name in tests else F.col(name) for name in columns]
    both = stored(judged.select(F.struct(*values).alias("row"), "_why", "_line"), "checked")
    found = seen.get
    reasons = {reason: found[f"n_{i}"] for i, reason in enumerate(("record", *tests)) if found[f"n_{i}"]}
    rejects = both.where(F.size("_why") > 0).select(F.col("_line").alias("line"), F.col("_why").alias("reasons"))
    return CheckedRows(both.where(F.size("_why") == 0).select("row.*"), rejects, found["lines"], found["kept"], reasons)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """Stored P&L, long or wide, as (unit, pnl_group, concept, month, amount).

    A wide report has one column per month; the month columns are recognised by their names.
    """
    frame = spark.read.parquet(path)
    months = report_months(frame)
    if not months:
        return frame
    keys = [c for c in frame.columns if c not in months]
    long = frame.unpivot(keys, months, "month", "amount")
    return long.filter(F.col("amount").isNotNull())


def report_months(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if MONTH_COLUMN.match(c)]


def considered_accounts(policy: DataFrame) -> DataFrame:
    """Policy rows flagged "Si", with canonical account numbers."""
    return policy.filter(cl.is_considered(F.col("consider"))).withColumn(
        "account_no", tx.canonical_account_no(F.col("account_no"))
    )
