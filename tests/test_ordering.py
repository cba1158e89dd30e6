"""Total order over ranges."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallywright.operators.ordering import PLACE, RANGE, in_ranges, with_positions
from tallywright.sinks import report

SCHEMA = "a string, b int, c double, text string"


def odd_rows(n=800):
    rng = random.Random(4)
    rows = [(rng.choice([None, "x", "y", "é", "Z", ""]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, -1.0]), str(rng.randint(0, 300))) for _ in range(n)]
    # two thirds of all rows share one key; a quarter are copies of one row
    rows += [("hot", 7, None, str(i)) for i in range(2 * n)] + [("hot", 7, 1.0, "copy")] * n
    rng.shuffle(rows)
    return rows


def by_hand(rows, order):
    def key(row):
        columns = [*order, *(i for i in range(4) if i not in order)]
        return [(row[i] is None, row[i].encode() if isinstance(row[i], str) else 0 if row[i] is None else row[i]) for i in columns]

    return [(*row, i + 1) for i, row in enumerate(sorted(rows, key=key))]


def test_positions_are_those_of_a_full_sort(spark):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for order, ranges in (((0, 1), 16), ((1, 3), 3), ((2,), None)):
        got = with_positions(frame, [SCHEMA.split(", ")[i].split()[0] for i in order], ranges=ranges).collect()
        assert sorted(map(tuple, got), key=lambda r: r[4]) == by_hand(rows, order)


def test_hot_key_and_copies_are_spread_over_ranges(spark):
    rows = odd_rows()
    ranged = in_ranges(spark.createDataFrame(rows, SCHEMA).repartition(5), ["a", "b"], ranges=16)
    sizes = [r["count"] for r in ranged.groupBy(RANGE).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * len(rows) / 16
    assert ranged.where("text = 'copy'").select(RANGE).distinct().count() > 1
    # places are whole in each range
    assert ranged.groupBy(RANGE).agg((F.max(PLACE) + 1 == F.count("*")).alias("whole")).where("not whole").count() == 0


def test_ties_may_be_named_and_an_empty_table_stays_empty(spark):
    frame = spark.createDataFrame([("x", 2, 1.0, "b"), ("x", 1, 2.0, "a"), (None, 0, 0.0, "z")], SCHEMA)
    got = with_positions(frame, ["a"], ties=["text"], name="row").orderBy("row").collect()
    assert [(r["text"], r["row"]) for r in got] == [("a", 1), ("b", 2), ("z", 3)]
    assert with_positions(frame.limit(0), ["a"]).collect() == []


def test_written_reports_put_nulls_last(spark, tmp_path):
    frame = spark.createDataFrame([("u", None, 1), ("u", "a", 2), ("u", "b", 3)], "unit string, concept string, n int").coalesce(1)
    report.write_report({"r": frame}, str(tmp_path), partition_by=("unit",), sort_within=("concept",))
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "r")).collect()] == [2, 3, 1]
