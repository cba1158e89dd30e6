"""Payroll: accrued cost, liability fallback, apportionment of charges.

Closed months come from the accrual accounts (accounting date), later months from the
liability accounts (load date). The last month with accrued salaries is the cutoff.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import classify as cl
from ..functions import money as mo
from ..functions import periods as pe
from ..functions import text as tx
from ..rules import Rules
from ..schemas import AMOUNT, Books
from .ledger import postings

ACCRUAL, LIABILITY, POOL = "accrual", "liability", "pool"


def payroll_accounts(accounts: DataFrame, rules: Rules) -> DataFrame:
    """Payroll accounts with role, kind, unit and sub-class, all decided on the account list.

    Accounts that get no unit (accrual, liability) have no place in a report and go here.
    """
    roles = {code: ACCRUAL for code in rules.accrual_kinds}
    roles |= {code: LIABILITY for code in rules.liability_units}
    roles |= {code: POOL for code in rules.all_pool_codes}
    code = F.col("class_code")
    key = F.expr(rules.subclass_key_sql)
    role = cl.decode(code, roles)
    return (
        accounts.filter(code.isin(*roles))
        .withColumn("role", role)
        .withColumn("kind", cl.decode(code, rules.accrual_kinds))
        .withColumn(
            "unit",
            F.when(F.col("role") == ACCRUAL, F.expr(rules.accrual_unit_sql)).when(
                F.col("role") == LIABILITY, cl.decode(code, rules.liability_units)
            ),
        )
        .withColumn("subclass", cl.subclass(key, rules.subclass_labels, R.UNCLASSIFIED))
        # only accrued cost is split in the P&L; a liability account stands for its whole unit
        .withColumn(
            "subclass_pivot",
            F.when(F.col("role") == ACCRUAL, cl.subclass(key, rules.subclass_pivot_labels, "")).otherwise(""),
        )
        .filter((F.col("role") == POOL) | F.col("unit").isNotNull())
    )


def payroll_postings(
    books: Books, rules: Rules, roles: tuple[str, ...] = (ACCRUAL, LIABILITY, POOL)
) -> DataFrame:
    """Usable payroll rows of the given roles, one scan for all of them.

    Accrual: base and provision rows with an accounting date. Liability: debit rows that are no
    closing entries. Pool: debit rows. ``month`` is the accounting month for accrual rows and
    the load month for the others.
    """
    accounts = payroll_accounts(books["account"], rules).filter(F.col("role").isin(*roles))
    # the other roles count debit lines alone, which is known before the journal
    rows = postings(books, rules, accounts, texts_last=True, lines=(F.col("role") == ACCRUAL) | (F.col("side") == 0))
    category = cl.noise_category(F.col("origin_code"), F.col("detail"), rules)
    role = F.col("role")
    accrued = (role == ACCRUAL) & F.col("accounting_at").isNotNull() & category.isin("base", "provision")
    owed = (role == LIABILITY) & (F.col("side") == 0) & ~tx.contains(F.col("detail"), rules.closing_text)
    pooled = (role == POOL) & (F.col("side") == 0)
    moment = F.when(role == ACCRUAL, F.col("accounting_at")).otherwise(F.col("loaded_at"))
    return rows.filter((accrued | owed | pooled) & moment.isNotNull()).select(
        "role",
        "kind",
        "unit",
        "subclass",
        "subclass_pivot",
        "account_no",
        "class_code",
        "account_name",
        moment.alias("moment"),
        pe.month_of(moment).alias("month"),
        F.when(role == ACCRUAL, category).alias("category"),
        F.when(role == ACCRUAL, mo.signed_amount(F.col("amount"), F.col("side")))
        .otherwise(F.col("amount"))
        .alias("amount"),
        "origin",
    )


def payroll_cells(rows: DataFrame) -> DataFrame:
    """Sums per account and month: ``base``, ``provision`` and the ``amount`` that counts.

    An accrual cell counts its base rows if they do not sum to zero, otherwise its provision
    rows (null where it has none). Deciding on aggregated cells means that no row has to find
    its group: a hot account-month is summed map-side like any other.
    """
    base = F.when((F.col("role") != ACCRUAL) | (F.col("category") == "base"), F.col("amount"))
    provision = F.when(F.col("category") == "provision", F.col("amount"))
    return (
        rows.groupBy("role", "kind", "unit", "subclass", "subclass_pivot", "account_no", "month")
        .agg(F.sum(base).alias("base"), F.sum(provision).alias("provision"))
        .withColumn("amount", counted(F.col("role"), F.col("base"), F.col("provision")))
    )


def uses_base(base: Column) -> Column:
    return F.coalesce(base, F.lit(0)) != 0


def counted(role: Column, base: Column, provision: Column) -> Column:
    return F.when((role != ACCRUAL) | uses_base(base), base).otherwise(provision)


def payroll_cutoff(cells: DataFrame) -> DataFrame:
    """One row: the last month with accrued salaries, over all units. Null if there is none.

    Written as a conditional aggregate without a filter, so that as a scalar subquery it reads
    the very same shuffle as the frame it is compared with.
    """
    return cells.agg(F.max(F.when(is_salary_cell(), F.col("month"))).alias("cutoff"))


def is_salary_cell() -> Column:
    return (F.col("role") == ACCRUAL) & (F.col("kind") == R.SALARIES) & F.col("amount").isNotNull()


def payroll_months(cells: DataFrame, rules: Rules, per_unit_cutoff: bool = False, cutoff: Column | None = None) -> DataFrame:
    """Hybrid payroll by unit, kind, sub-class and month.

    ``cutoff`` is the last closed month where it is known; else it is looked up in the cells.

    Closed months: accrued amounts. Later months: liability salaries as they are, and the pooled
    charges of the month split by each unit's share of the month's salaries. Pool months without
    salaries vanish, a month without pool gives zero charges.

    The monthly frame is bounded by roles x units x kinds x sub-classes x calendar months,
    whatever the size of the ledger; windows only run on that.
    """
    by_month = (
        cells.filter(F.col("amount").isNotNull())
        .groupBy("role", "kind", "unit", "subclass_pivot", "month")
        .agg(F.sum("amount").alias("amount"))
    )
    if per_unit_cutoff:
        salary_month = F.when((F.col("role") == ACCRUAL) & (F.col("kind") == R.SALARIES), F.col("month"))
        by_month = by_month.withColumn("cutoff", F.max(salary_month).over(Window.partitionBy("unit")))
        closed = F.col("month") <= F.col("cutoff")
        later = F.col("month") > F.col("cutoff")
    else:
        cutoff = payroll_cutoff(cells).scalar() if cutoff is None else cutoff
        closed = F.col("month") <= cutoff
        later = F.col("month") > cutoff
    # pool rows carry no unit, so the later months are kept for every unit here and the
    # per-unit test runs on the liability rows below
    of_month = Window.partitionBy("month")
    owed = F.when(F.col("role") == LIABILITY, F.col("amount"))
    pool = F.when(F.col("role") == POOL, F.col("amount"))
    enriched = by_month.withColumn("owed_total", F.sum(owed).over(of_month)).withColumn(
        "pool_total", F.sum(pool).over(of_month)
    )
    accrued = (F.col("role") == ACCRUAL) & (F.col("month") >= F.lit(rules.first_month)) & closed
    fallback = (F.col("role") == LIABILITY) & later
    share = F.try_divide(F.col("amount").cast("double"), F.col("owed_total").cast("double"))
    charges = (F.coalesce(F.col("pool_total").cast("double"), F.lit(0.0)) * share).cast(AMOUNT)
    actual = F.col("amount").cast(AMOUNT)
    none = F.lit(None).cast("double")
    entry = F.when(
        F.col("role") == ACCRUAL,
        F.array(_entry(F.col("kind"), F.col("subclass_pivot"), actual, none, F.lit(False))),
    ).otherwise(
        F.array(
            _entry(F.lit(R.SALARIES), F.lit(R.UNCLASSIFIED_PIVOT), actual, share, F.lit(True)),
            _entry(F.lit(R.CHARGES), F.lit(R.UNCLASSIFIED_PIVOT), charges, share, F.lit(True)),
        )
    )
    kept = enriched.filter(accrued | fallback).withColumn("entry", F.explode(entry))
    split = F.when((F.col("unit") == rules.unit_a) & (F.col("entry.subclass") != ""), F.col("entry.subclass"))
    return kept.select(
        "unit",
        "month",
        F.col("entry.kind").alias("kind"),
        payroll_concept(F.col("entry.kind"), split, F.col("unit")).alias("concept"),
        F.col("entry.amount").alias("amount"),
        F.col("entry.share").alias("share"),
        F.col("entry.fallback").alias("fallback"),
    )


def _entry(kind: Column, subclass: Column, amount: Column, share: Column, fallback: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        subclass.alias("subclass"),
        amount.alias("amount"),
        share.alias("share"),
        fallback.alias("fallback"),
    )


def payroll_concept(kind: Column, subclass: Column, unit: Column) -> Column:
    """``Sueldos <sub-class> - <unit>``; a null or empty sub-class is left out."""
    named = F.nullif(subclass, F.lit(""))
    return F.concat(F.concat_ws(" ", kind, named), F.lit(" - "), unit)


def payroll_hybrid(books: Books, rules: Rules, per_unit_cutoff: bool = False) -> DataFrame:
    """Monthly payroll rows of a P&L: unit, month, kind, concept, amount."""
    cells = payroll_cells(payroll_postings(books, rules))
    return (
        payroll_months(cells, rules, per_unit_cutoff)
        .groupBy("unit", "month", "kind", "concept")
        .agg(F.sum("amount").alias("amount"))
    )


def accrual_months(books: Books, rules: Rules) -> DataFrame:
    """Accrued payroll of the closed months: unit, kind, sub-class, concept, month, amount."""
    cells = payroll_cells(payroll_postings(books, rules, (ACCRUAL,)))
    cutoff = payroll_cutoff(cells).scalar()
    month = F.col("month")
    split = F.when(F.col("unit") == rules.unit_a, F.col("subclass_pivot"))
    return (
        cells.filter(F.col("amount").isNotNull() & (month >= F.lit(rules.first_month)) & (month <= cutoff))
        .withColumn("concept", payroll_concept(F.col("kind"), split, F.col("unit")))
        .groupBy("unit", "kind", "subclass", "concept", "month")
        .agg(F.sum("amount").alias("amount"))
    )


def base_or_provision(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Accrual rows that count, row by row (for the movement fact); other roles pass.

    Rows meet their cell by a join, which the skew handling of adaptive execution can split; a
    window per cell could not. Cells of other roles go after the aggregate: a filter on the role
    would reach down to the ledger and set it apart from the frames that share its shuffles.
    """
    use_base = F.when(F.col("role") == ACCRUAL, uses_base(F.col("base")))
    flags = (
        cells.groupBy(F.col("account_no").alias("cell_account"), F.col("month").alias("cell_month"))
        .agg(F.bool_or(use_base).alias("use_base"))
        .filter(F.col("use_base").isNotNull())
    )
    same_cell = (F.col("account_no") == F.col("cell_account")) & (F.col("month") == F.col("cell_month"))
    kept = (F.col("role") != ACCRUAL) | ((F.col("category") == "base") == F.col("use_base"))
    return rows.join(flags, same_cell, "left").filter(kept).drop("cell_account", "cell_month", "use_base")


def payroll_fact(books: Books, rules: Rules) -> DataFrame:
    """Payroll rows of the movement fact: accrued rows, liability rows, apportioned charges.

    The cells (which give the cutoff, the base-or-provision flags and the apportioned charges) and
    the rows come from the same postings, so that they can share the shuffle by journal.
    """
    postings_of_all = payroll_postings(books, rules)
    cells = payroll_cells(postings_of_all)
    cutoff = payroll_cutoff(cells).scalar()
    month, role = F.col("month"), F.col("role")
    rows = base_or_provision(postings_of_all.filter(role.isin(ACCRUAL, LIABILITY)), cells)
    closed = (role == ACCRUAL) & (month >= F.lit(rules.first_month)) & (month <= cutoff)
    later = (role == LIABILITY) & (month > cutoff)
    accrued = role == ACCRUAL
    detailed = rows.filter(closed | later).select(
        "unit",
        "moment",
        "month",
        F.when(accrued, F.col("kind")).otherwise(R.SALARIES).alias("concept"),
        "account_no",
        F.col("amount").cast(AMOUNT).alias("amount"),
        F.when(accrued, R.DETAIL_ACCRUED).otherwise(R.DETAIL_LIABILITY).alias("detail"),
        F.when(accrued, F.col("subclass")).otherwise(R.UNCLASSIFIED).alias("party"),
        F.lit(R.ORIGIN_PAYROLL).alias("source"),
        "origin",
    )
    charges = payroll_months(cells, rules).filter(F.col("fallback") & (F.col("kind") == R.CHARGES))
    charges = charges.select(
        "unit",
        "month",
        F.lit(R.CHARGES).alias("concept"),
        "amount",
        F.lit(R.DETAIL_LIABILITY).alias("detail"),
        F.lit(R.UNCLASSIFIED).alias("party"),
    )
    return detailed.unionByName(charges, allowMissingColumns=True)


def payroll_split(books: Books, rules: Rules) -> DataFrame:
    """Unit A by sub-class, with guaranteed columns: amounts and percentages per kind and month."""
    first, second = list(dict.fromkeys(rules.subclass_labels.values()))
    months = accrual_months(books, rules).filter(F.col("unit") == rules.unit_a)
    wide = (
        months.groupBy("kind", "month")
        .pivot("subclass", [first, second])
        .agg(F.sum("amount"))
        .select(
            "kind",
            "month",
            F.coalesce(F.col(first), F.lit(0)).alias("operations"),
            F.coalesce(F.col(second), F.lit(0)).alias("administration"),
        )
    )
    total = F.col("operations") + F.col("administration")

    def percent(part: str) -> Column:
        ratio = F.try_divide(F.col(part).cast("double"), F.nullif(F.col("total").cast("double"), F.lit(0.0)))
        return F.bround(ratio * 100, 1)

    return wide.withColumn("total", total).withColumns(
        {"operations_pct": percent("operations"), "administration_pct": percent("administration")}
    )


def reconcile(books: Books, rules: Rules) -> DataFrame:
    """Unit A salaries by month: liability method against accrual method, full outer.

    A month after the cutoff is flagged as fallback.
    """
    cells = payroll_cells(payroll_postings(books, rules, (ACCRUAL, LIABILITY)))
    cutoff = payroll_cutoff(cells).scalar()
    month = F.col("month")
    unit_a = cells.filter((F.col("unit") == rules.unit_a) & F.col("amount").isNotNull())
    closed = (F.col("kind") == R.SALARIES) & (month >= F.lit(rules.first_month)) & (month <= cutoff)
    # both methods sit in one frame already, so the full outer join by month is one aggregate
    return (
        unit_a.withColumn("owed", F.when(F.col("role") == LIABILITY, F.col("amount")))
        .withColumn("accrued", F.when((F.col("role") == ACCRUAL) & closed, F.col("amount")))
        .filter(F.col("owed").isNotNull() | F.col("accrued").isNotNull())
        .groupBy("month")
        .agg(F.sum("owed").alias("owed"), F.sum("accrued").alias("accrued"))
        .withColumn("is_fallback", F.coalesce(month > cutoff, F.lit(False)))
    )


def reconcile_frames(left: DataFrame, right: DataFrame, cutoff: dt.date | None) -> DataFrame:
    """Full outer comparison of two monthly series computed elsewhere (month, amount)."""
    a = left.select("month", F.col("amount").alias("left_amount"))
    b = right.select("month", F.col("amount").alias("right_amount"))
    after = F.col("month") > F.lit(cutoff).cast("date")
    return a.join(b, "month", "full").withColumn("is_fallback", F.coalesce(after, F.lit(False)))


def fallback_months(comparison: DataFrame) -> DataFrame:
    """Number and sorted list of the flagged months: one row, at most one entry per month."""
    return comparison.agg(
        F.count_if("is_fallback").alias("months"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("is_fallback"), pe.month_text(F.col("month"))))), ","
        ).alias("month_list"),
    )
