"""Total order of a distributed table: every row gets its place, and no task sorts them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

RANGE, PLACE = "_range", "_place"
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def in_ranges(frame: DataFrame, order: Sequence[str], ties: Sequence[str] | None = None, ranges: int | None = None) -> DataFrame:
    """The rows, stored in sorted ranges, with number of the range and place inside it (from 0). Nulls go last.

    ``ties`` (all other columns if not given) split rows that are equal in ``order``; the order of arrival
    splits those equal in every column. So a key that holds a third of all rows is cut into ranges like
    any other stretch, and copies of one row are too. The rows are stored before they are sorted: the
    bounds of the ranges come from a sample, which reads its input once more, and the order of arrival is
    only the same in a retried task if it is that of a file.
    """
    spark = frame.sparkSession
    rest = [c for c in frame.columns if c not in order] if ties is None else [c for c in ties if c not in order]
    rows = stored(frame, "unsorted").withColumn("_arrival", F.monotonically_increasing_id())
    keys = [*(F.col(f"`{c}`").asc_nulls_last() for c in (*order, *rest)), F.col("_arrival").asc()]
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(count, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    placed = sorted_rows.withColumns({RANGE: F.shiftright(number, _ROW_BITS), PLACE: number.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
    return stored(placed.drop("_arrival"), "sorted")


def with_positions(
    frame: DataFrame, order: Sequence[str], ties: Sequence[str] | None = None, ranges: int | None = None, name: str = "position"
) -> DataFrame:
    """The rows with their position (from 1) in the order of ``order``, nulls last, ties by ``ties``.

    A row's position is its place in its range plus the rows of the ranges before; that sum runs over one
    row a range. Rows equal in every column take neighbouring positions, in any order.
    """
    rows = in_ranges(frame, order, ties, ranges)
    before = F.sum("count").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(RANGE).count().select(RANGE, F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(starts, RANGE).withColumn(name, F.col("_before") + F.col(PLACE) + 1).drop(RANGE, PLACE, "_before")
