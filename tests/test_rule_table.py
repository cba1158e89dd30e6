"""Rules as a table against the same rules one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import expenses as ex
from tallywright.operators.rule_table import RULES, apply_rules
from tallywright.rules import ORDERS
from tallywright.sources.order_books import load_order_books

ROWS = "party string, unit string, concept string, n int"
TEXTS = ["Alfa SA", " alfa sa ", "ALFA SA", "Beta y Alfa", "b", "ab", "abc", "xabcx", "", "  ", "ñandú 7", "ÑANDÚ", None, "a%b", "a.b", "dada"]


def by_hand(rows, rules):
    out = []
    for party, unit, concept, n in rows:
        best = None
        for rule in sorted(rules, key=lambda r: r[0]):
            _, field, test, pattern, *_ = rule
            if field != "party" or party is None or pattern is None:
                continue
            if party.strip(" ").upper() == pattern.strip(" ").upper() if test == "equals" else pattern and pattern.lower() in party.lower():
                best = rule
                break
        if best:
            _, _, _, _, to, find, new, whole = best
            unit = unit if to is None else to
            concept = whole if whole is not None else concept.replace(find, new or "") if find and concept is not None else concept
        out.append((party, unit, concept, n))
    return out


def some_rules(rng, count):
    patterns = [t for t in TEXTS if t is not None] + ["a", "sa", "da", "ANDÚ", "%", ".", "y al", "zzz", "nothing", " "]
    rules = []
    for i in range(count):
        change = rng.choice([("U%d" % i, None, None, None), (None, "Econ", "Prom", None), ("V", None, None, "C%d" % i), (None, None, None, None), ("W", "", "x", None)])
        rules.append((1000 - i, rng.choice(["party", "party", "party", "detail"]), rng.choice(["equals", "contains"]), rng.choice(patterns), *change))
    return rules + [(1, "party", "contains", None, "never", None, None, None), (2, "party", "contains", "", "never", None, None, None)]


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("count", [0, 3, 12, 40])
def test_first_match_by_priority(spark, count):
    rng = random.Random(count)
    rules = some_rules(rng, count)
    # half of all rows carry one text
    rows = [(rng.choice([*TEXTS, *["Beta y Alfa"] * 16]), rng.choice(["A", None]), rng.choice(["Econ Econ x", "other", None]), i) for i in range(300)]
    got = apply_rules(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(rules, RULES), "party")
    assert got.columns == ["party", "unit", "concept", "n"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, rules), key=key)


def plan_size(frame):
    return len(frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_thousands_of_rules_are_one_plan(spark, tmp_path):
    rows = spark.createDataFrame([(f"Party number {i}", "A", "Econ", i) for i in range(2000)] + [(None, "A", "Econ", -1)], ROWS)
    many = [(i, "party", "equals" if i % 2 else "contains", f"PARTY number {i}", f"U{i}", None, None, None) for i in range(5000)]
    plans = []
    for name, rules in (("few", many[:5]), ("many", many)):
        spark.createDataFrame(rules, RULES).write.parquet(str(tmp_path / name))
        made = apply_rules(rows, spark.read.parquet(str(tmp_path / name)), "party")
        plans.append(plan_size(made))
        got = {r["n"]: r["unit"] for r in made.collect()}
        # the least number that the text holds: "number 1234" holds "number 12", which has the lower priority
        held = {r[0] for r in rules}
        for n in (0, 7, 12, 125, 1998, 1999, -1):
            text = f"party number {n}"
            hits = [i for i in held if n >= 0 and (text == f"party number {i}" if i % 2 else f"party number {i}" in text)]
            assert got[n] == (f"U{min(hits)}" if hits else "A")
    assert plans[0] == plans[1]


def test_same_rows_as_the_rules_in_code(spark, small):
    books = load_order_books(spark, small)
    rules = [(i, "party", "equals", o.party, o.unit, o.find, o.replace, None) for i, o in enumerate(ORDERS.party_overrides)]
    rules += [(i, "detail", "equals", o.detail, o.unit, None, None, o.concept) for i, o in enumerate(ORDERS.detail_overrides)]
    table = spark.createDataFrame(rules, RULES)
    plain = ex.expense_rows(books, ORDERS, with_overrides=False)
    got = apply_rules(apply_rules(plain, table, "party"), table, "detail")
    want = ex.detail_overrides(ex.expense_rows(books, ORDERS), ORDERS)

    def totals(frame):
        return {tuple(r) for r in frame.groupBy("unit", "concept", "party").agg(F.count("*"), F.sum("amount")).collect()}

    assert totals(got) == totals(want)
