"""Ledger tables laid out for their join: lines and journals in the same buckets, by load month.

A run of many products joins lines and journals again and again. Stored in equal buckets by journal, the
two meet without a shuffle, and a floor on the load date skips whole months of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import Books

KEY, MONTH = "journal_id", "load_month"


def _bucketed(frame: DataFrame, buckets: int, table: str, path: str) -> None:
    writer = frame.repartition(buckets, KEY).write.mode("overwrite").option("path", path).bucketBy(buckets, KEY).sortBy(KEY)
    if MONTH in frame.columns:
        writer = writer.partitionBy(MONTH)
    writer.saveAsTable(table)


def _dated(frame: DataFrame) -> DataFrame:
    return frame.withColumn(MONTH, F.date_format("loaded_at", "yyyy-MM")) if "loaded_at" in frame.columns else frame


def hot_journals(lines: DataFrame, buckets: int) -> DataFrame:
    """Journals with more lines than an even bucket holds: fewer than ``buckets`` of them, whatever the data."""
    counts = lines.where(F.col(KEY).isNotNull()).groupBy(KEY).count()
    return counts.where(F.col("count") * buckets > lines.agg(F.count("*")).scalar()).select(KEY)


def store_ledger(books: Books, folder: str, name: str, buckets: int = 64) -> Books:
    """Books that read lines and journals from bucketed tables ``<name>_line`` and ``<name>_journal`` under ``folder``.

    The side that has the load date is split into folders by load month too. A journal too large for a bucket
    would keep one task busy in every join, since a bucketed scan is not split: those journals (fewer than
    ``buckets``) are joined with their lines once and stored apart, in files of even size. ``folder`` belongs
    on shared storage; the tables are external, so dropping them leaves the files.
    """
    lines, journals = _dated(books["journal_line"]), _dated(books["journal"])
    spark = lines.sparkSession
    hot = hot_journals(lines, buckets)
    path = f"{folder}/{name}"
    # the anti joins carry a null key along: a line without a journal stays a line
    _bucketed(lines.join(hot, KEY, "left_anti"), buckets, f"{name}_line", f"{path}_line")
    _bucketed(journals.join(hot, KEY, "left_anti"), buckets, f"{name}_journal", f"{path}_journal")
    # fewer than ``buckets`` rows on the side of the hot journals, so their headers go to the lines
    apart = lines.join(F.broadcast(hot), KEY).join(F.broadcast(journals.join(F.broadcast(hot), KEY)), KEY)
    laid_out = apart.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, "account_id")
    laid_out.write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}_hot")
    return books.replaced(
        co_line=spark.table(f"{name}_line"),
        co_journal=spark.table(f"{name}_journal"),
        hot_posting=spark.read.schema(apart.schema).parquet(f"{path}_hot"),
    )
