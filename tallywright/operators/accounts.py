"""Chart of accounts: policy, units, de-duplication, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import text as tx
from ..rules import Rules
from ..schemas import Books
from .ledger import account_names


def policy_by_number(policy: DataFrame, rules: Rules) -> DataFrame:
    """One row per canonical account number: is it considered, and which unit does its name give?

    A number may appear more than once. It is considered if any of its rows is, and its unit
    comes from its considered rows only; if those give both units, the second one holds.
    """
    rows = policy.select(
        tx.canonical_account_no(F.col("account_no")).alias("account_no"),
        cl.is_considered(F.col("consider")).alias("considered"),
        cl.unit_of_name(F.col("account_name"), rules).alias("name_unit"),
    ).filter("considered")
    # flags, not names: boolean sums stay in the hash aggregate
    flags = rows.groupBy("account_no").agg(
        F.bool_or("considered").alias("considered"),
        *[F.bool_or(F.col("name_unit") == unit).alias(f"in_{i}") for i, unit in enumerate(rules.units)],
    )
    unit = F.when(F.col("in_1"), rules.unit_b).when(F.col("in_0"), rules.unit_a)
    return flags.select("account_no", "considered", unit.alias("unit"))


def account_card(books: Books, rules: Rules) -> DataFrame:
    """Accounts with concept, policy flag and unit."""
    return (
        account_names(books["account"])
        .join(policy_by_number(books["account_policy"], rules), "account_no", "left")
        .withColumn("considered", F.coalesce("considered", F.lit(False)))
    )


def policy_preferred(policy: DataFrame) -> DataFrame:
    """One policy row per number, "Si" rows first (then by name, so that the pick is stable).

    Written as an aggregate: one row per number leaves each task.
    """
    rows = policy.withColumn("account_no", tx.canonical_account_no(F.col("account_no"))).withColumn(
        "considered", cl.is_considered(F.col("consider"))
    )
    best = F.min(F.struct((~F.col("considered")).alias("rank"), F.col("account_name"))).alias("best")
    return rows.groupBy("account_no").agg(best).select(
        "account_no", F.col("best.account_name").alias("account_name"), (~F.col("best.rank")).alias("considered")
    )


def account_unit_lists(books: Books, rules: Rules) -> DataFrame:
    """Considered account numbers with the unit their name gives."""
    return policy_by_number(books["account_policy"], rules).filter(F.col("unit").isNotNull()).select("account_no", "unit")


def account_search(
    books: Books, prefix: str, words: tuple[str, ...] | list[str]
) -> DataFrame:
    """Accounts of a number class, or with one of ``words`` anywhere in the name (any case)."""
    return books["account"].filter(
        F.coalesce(F.col("account_no").startswith(prefix), F.lit(False))
        | tx.contains_any(F.col("account_name"), words)
    ).select("account_no", "account_name", "level", "postable")
