"""Override rules as a table: any number of rules, one plan.

A rule names a text column, how its text is tested and what becomes of a row that passes; where several
pass, the one of least priority number holds. Rules meet distinct texts and not rows: equality by a join on
the text, containment by a join on one gram of the pattern, the one that fewest texts have, and a test of
what that join brings together. A gram of three characters, or the whole of a shorter pattern, stands in
every text that holds the pattern, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "priority long, field string, test string, pattern string, unit string, find string, replace string, concept string"
EQUALS, CONTAINS = "equals", "contains"
GRAM = 3
_CHANGE = ("unit", "find", "replace", "concept")


def _key(text: Column) -> Column:
    """Equality is that of trimmed texts in any case."""
    return F.upper(F.trim(text))


def _substrings(text: Column, size: Column) -> Column:
    """All substrings of one size; none where the text is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substr(text, at, size))


def _contained(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``text`` and rule of every pattern that stands in a text."""
    patterns = rules.withColumn("low", F.lower("pattern")).where(F.length("low") > 0)
    # grams of a pattern have one size, its own or GRAM
    of_rule = patterns.withColumn("gram", F.explode(F.array_distinct(_substrings(F.col("low"), F.least(F.length("low"), F.lit(GRAM))))))
    every = F.concat(*(_substrings(F.lower("text"), F.lit(size)) for size in range(1, GRAM + 1)))
    of_text = texts.select("text", F.explode(F.array_distinct(every)).alias("gram"))
    of_text = of_text.join(of_rule.select("gram").distinct(), "gram")
    often = of_text.groupBy("gram").count()
    keys = ["priority", "pattern", "low", *_CHANGE]
    # a gram that no text has makes its rule impossible: the count is null and the rule goes
    anchors = (
        of_rule.join(often, "gram", "left")
        .groupBy(*keys)
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("rarest"))
        .where("rarest.n > 0")
        .select(*keys, F.col("rarest.gram").alias("gram"))
    )
    found = of_text.join(anchors, "gram").where(F.lower("text").contains(F.col("low")))
    return found.select("text", "priority", *_CHANGE)


def matched(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``text, rule`` (priority and change) of the first rule that each text passes. Texts are distinct and not null."""
    equal = rules.where(F.col("test") == EQUALS).withColumn("key", _key(F.col("pattern")))
    exact = texts.withColumn("key", _key(F.col("text"))).join(equal, "key").select("text", "priority", *_CHANGE)
    hits = exact.unionByName(_contained(texts, rules.where(F.col("test") == CONTAINS)))
    return hits.groupBy("text").agg(F.min(F.struct("priority", *_CHANGE)).alias("rule"))


def apply_rules(rows: DataFrame, rules: DataFrame, field: str) -> DataFrame:
    """The rows with the unit and concept of the first rule on ``field`` that they pass.

    ``unit`` and ``concept`` of a rule replace those of the row; without a concept, ``find`` in the row's
    concept becomes ``replace``. What a rule leaves null stays. Rows without a text pass no rule. Rules of
    one priority are taken in the order of their columns, nulls first.
    """
    mine = rules.where(F.col("field") == field)
    texts = rows.select(F.col(field).alias("text")).where(F.col("text").isNotNull()).distinct()
    best = matched(texts, mine).withColumnsRenamed({"text": "_text", "rule": "_rule"})
    joined = rows.join(best, rows[field] == best["_text"], "left")
    renamed = F.when(F.col("_rule.find") != "", F.replace(F.col("concept"), F.col("_rule.find"), F.coalesce("_rule.replace", F.lit(""))))
    changed = joined.withColumns(
        {
            "unit": F.coalesce("_rule.unit", "unit"),
            "concept": F.coalesce("_rule.concept", renamed, "concept"),
        }
    )
    return changed.select(*rows.columns)
