"""Operating expenses: selection, sign, unit, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import money as mo
from ..functions import periods as pe
from ..functions import text as tx
from ..rules import Rules
from ..schemas import Books
from .accounts import account_card
from .ledger import postings


def expense_accounts(books: Books, rules: Rules, literal: bool = False) -> DataFrame:
    """Accounts of the expense block.

    An account is in if policy says so or if its name is an upkeep name; payroll accrual accounts
    are out. By default an account that meets both tests is in once. With ``literal`` it is in
    twice, the way two lists put end to end would have it.
    """
    card = account_card(books, rules).filter(
        ~F.coalesce(F.col("class_code").isin(*rules.accrual_kinds), F.lit(False))
    )
    by_policy = F.col("considered")
    by_name = tx.contains(F.col("concept"), rules.upkeep_pattern)
    if not literal:
        return card.filter(by_policy | by_name)
    times = by_policy.cast("int") + by_name.cast("int")
    return card.filter(by_policy | by_name).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def accepted_origin(rules: Rules) -> Column:
    """Purchases, plus (account, origin) pairs listed as exceptions. Unknown origins do not pass."""
    test = F.col("origin") == rules.expense_origin
    for code, origin in rules.expense_exceptions:
        test = test | ((F.col("class_code") == code) & (F.col("origin") == origin))
    return F.coalesce(test, F.lit(False))


def possible_origin(rules: Rules) -> Column:
    """The journal's part of ``accepted_origin``: no journal that fails it has an accepted row."""
    origins = {rules.expense_origin, *(origin for _, origin in rules.expense_exceptions)}
    return F.col("origin_code").isin([code for code, origin in rules.origin_labels.items() if origin in origins])


def expense_rows(
    books: Books,
    rules: Rules,
    literal: bool = False,
    with_party: bool = True,
    with_overrides: bool = True,
) -> DataFrame:
    """Expense postings with unit, concept, month and sign.

    When the party itself is not wanted (``with_party=False``) the overrides still need it, but
    only the few parties they name: the party list is cut to those before the join.
    """
    accounts = expense_accounts(books, rules, literal)
    rows = postings(books, rules, accounts, texts_last=True, journals=possible_origin(rules)).filter(
        accepted_origin(rules) & ~tx.contains(F.col("detail"), rules.expense_noise_text)
    )
    parties = books["origin_party"]
    if not with_party:
        parties = parties.filter(_override_key(F.col("party")).isin(*[o.party for o in rules.party_overrides]))
    if with_party or rules.party_overrides:
        rows = rows.join(parties, "origin_id", "left")
    else:
        rows = rows.withColumn("party", F.lit(None).cast("string"))
    rows = rows.withColumn("amount", mo.flip_reversals(F.col("amount"), F.col("detail"), rules.reversal_text))
    if with_overrides:
        rows = party_overrides(rows, rules)
    return rows.select(
        "unit",
        F.col("loaded_at").alias("moment"),
        pe.month_of(F.col("loaded_at")).alias("month"),
        "concept",
        "account_no",
        "amount",
        "detail",
        "party",
        F.lit(R.ORIGIN_EXPENSES).alias("source"),
        "origin",
    )


def _override_key(party: Column) -> Column:
    return F.upper(F.trim(party))


def party_overrides(rows: DataFrame, rules: Rules) -> DataFrame:
    """Re-assign the rows of listed parties: unit, and one word of the concept. First rule wins."""
    unit, concept = None, None
    for o in rules.party_overrides:
        hit = _override_key(F.col("party")) == o.party
        renamed = F.replace(F.col("concept"), F.lit(o.find), F.lit(o.replace)) if o.find else F.col("concept")
        unit = F.when(hit, o.unit) if unit is None else unit.when(hit, o.unit)
        concept = F.when(hit, renamed) if concept is None else concept.when(hit, renamed)
    if unit is None:
        return rows
    return rows.withColumns({"unit": unit.otherwise(F.col("unit")), "concept": concept.otherwise(F.col("concept"))})


def detail_overrides(rows: DataFrame, rules: Rules) -> DataFrame:
    """Re-assign rows by their exact detail text: unit and whole concept."""
    unit, concept = None, None
    for o in rules.detail_overrides:
        hit = F.col("detail") == o.detail
        unit = F.when(hit, o.unit) if unit is None else unit.when(hit, o.unit)
        concept = F.when(hit, o.concept) if concept is None else concept.when(hit, o.concept)
    if unit is None:
        return rows
    return rows.withColumns({"unit": unit.otherwise(F.col("unit")), "concept": concept.otherwise(F.col("concept"))})


def expenses_monthly(
    books: Books, rules: Rules, literal: bool = False, consistent: bool = True
) -> DataFrame:
    """Expenses by unit, month, account and concept. Rows without a unit have no place.

    ``consistent`` also applies the detail overrides, so that the P&L adds up to the movement
    fact; the literal P&L leaves them to the fact.
    """
    rows = expense_rows(books, rules, literal, with_party=False).filter(F.col("unit").isNotNull())
    if consistent:
        rows = detail_overrides(rows.filter(F.col("unit").isin(*rules.units)), rules)
    keys = ["unit", "month", "account_no", "concept"]
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return rows.filter(present).groupBy(*keys).agg(F.sum("amount").alias("amount"))
