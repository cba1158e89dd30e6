"""Classification: codes to labels, text to categories, accounts to units and groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from ..rules import Rules
from . import text as tx


def decode(code: Column, labels: Mapping, default: str | None = None) -> Column:
    """Label of a code; unmapped and null codes give ``default`` (null if not set)."""
    chain = None
    for key, label in labels.items():
        chain = F.when(code == key, label) if chain is None else chain.when(code == key, label)
    return F.lit(default).cast("string") if chain is None else chain.otherwise(F.lit(default).cast("string"))


def unit_of_branch(branch_no: Column, rules: Rules, default: str | None = None) -> Column:
    return decode(branch_no, rules.branch_units, default or rules.unit_other)


def unit_of_name(name: Column, rules: Rules) -> Column:
    """Unit from the account name; where several patterns match, the first one wins."""
    chain = None
    for unit, pattern in rules.name_units:
        hit = tx.matches(name, pattern)
        chain = F.when(hit, unit) if chain is None else chain.when(hit, unit)
    return chain


def is_considered(flag: Column) -> Column:
    """Policy flag is "Si", whatever the case and blanks. An accented "Sí" is not accepted."""
    return F.coalesce(F.upper(F.trim(flag)) == "SI", F.lit(False))


def padded(number: Column, width: int, cut: bool = False) -> Column:
    """Digits with leading zeros; ``cut`` keeps only the first ``width`` digits of longer numbers, like LPAD."""
    digits = F.coalesce(number, F.lit(0)).cast("string")
    return F.lpad(digits, F.lit(width) if cut else F.greatest(F.char_length(digits), F.lit(width)), F.lit("0"))


def document_label(doc_type: Column, letter: Column, branch_no: Column, number: Column, cut: bool = False) -> Column:
    """``Factura (A) 0003-00001234``. Longer numbers stay whole unless ``cut``."""
    has_letter = F.concat(F.lit(" ("), decode(letter, R.DOCUMENT_LETTERS, ""), F.lit(")"))
    return F.concat(
        decode(doc_type, R.DOCUMENT_TYPES, R.DOCUMENT_OTHER),
        F.when(letter.isNotNull(), has_letter).otherwise(F.lit("")),
        F.lit(" "),
        padded(branch_no, 4, cut),
        F.lit("-"),
        padded(number, 8, cut),
    )


def noise_category(origin_code: Column, detail: Column, rules: Rules) -> Column:
    """One category per payroll row: closing entry, then the text marks in order, else base."""
    upper = F.upper(F.coalesce(detail, F.lit("")))
    chain = F.when(origin_code.isin(*rules.closing_origins), "cierre")
    for category, mark in rules.noise_texts:
        chain = chain.when(tx.matches(upper, mark), category)
    return chain.otherwise("base")


def subclass(key: Column, labels: Mapping[str, str], default: str) -> Column:
    """Sub-class from the first five characters of the account key."""
    return decode(F.substring(key, 1, 5), labels, default)


def with_order_prefix(concept: Column, payroll_words: tuple[str, ...] | None = None) -> Column:
    """00 sales, 01 payroll, 02 the rest. A concept that already has a prefix keeps it."""
    words = payroll_words or (R.SALARIES, R.CHARGES, R.UNION_DUES)
    payroll = F.lit(False)
    for word in words:
        payroll = payroll | concept.contains(word)
    return (
        F.when(concept.rlike(r"^\d{2}-"), concept)
        .when(concept.contains("Ventas netas"), F.concat(F.lit("00-"), concept))
        .when(payroll, F.concat(F.lit("01-"), concept))
        .otherwise(F.concat(F.lit("02-"), concept))
    )


def pnl_group(concept: Column) -> Column:
    return (
        F.when(concept.startswith("00-"), R.GROUP_SALES)
        .when(concept.startswith("01-"), R.GROUP_PAYROLL)
        .when(concept.isNotNull(), R.GROUP_EXPENSES)
    )


def concept_rank(concept: Column, order: tuple[str, ...]) -> Column:
    """Position in the custom order; concepts outside it come after, so sort by (rank, concept)."""
    positions = {name: i for i, name in enumerate(order)}
    chain = None
    for name, i in positions.items():
        chain = F.when(concept == name, i) if chain is None else chain.when(concept == name, i)
    return F.lit(len(order)) if chain is None else chain.otherwise(len(order))

