"""Ledger diagnostics: activity, noise, date shift, searches, capital accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import periods as pe
from ..functions import text as tx
from ..rules import SALARIES, Rules
from ..schemas import Books
from .accounts import policy_preferred
from .ledger import journal_rows, postings

# Category labels of the noise profile, ordered by their leading digit.
PROFILE_LABELS = {
    "cierre": "4_cierre",
    "infl": "2_infl",
    "reversion": "3_reversion",
    "provision": "3_provision",
    "base": "1_base",
}


def _debit(amount: Column) -> Column:
    return F.sum(F.when(F.col("side") == 0, amount).otherwise(F.lit(0)))


def _credit(amount: Column) -> Column:
    return F.sum(F.when(F.col("side") == 1, amount).otherwise(F.lit(0)))


def _rekeyed(key: str) -> Column:
    """The key in a form the join before did not partition by.

    Grouping by the join key itself would keep the join's partitioning, and a hot journal in one
    task. Under another key the sums start map-side, and adaptive execution may split the join.
    """
    return F.col(key).cast("string").alias(key)


def account_activity(books: Books, since: dt.date) -> DataFrame:
    """Activity per account (number, name) over the whole ledger, and since a load date.

    Rows are first summed per account and journal, so that the distinct journal count becomes a
    plain count and a hot account is spread over its journals in the widest shuffle.
    """
    accounts = books["account"].select("account_id", "account_no", "account_name")
    rows = journal_rows(books, accounts).select(
        "account_no", "account_name", _rekeyed("journal_id"), "loaded_at", "side", "amount"
    )
    recent = F.col("loaded_at") >= F.lit(since)
    amount = F.when(recent, F.col("amount")).otherwise(F.lit(0))
    per_journal = rows.groupBy("account_no", "account_name", "journal_id").agg(
        F.count("*").alias("n"),
        F.count_if(recent).alias("n_recent"),
        F.min("loaded_at").alias("first_at"),
        F.max("loaded_at").alias("last_at"),
        _debit(amount).alias("debit"),
        _credit(amount).alias("credit"),
    )
    return per_journal.groupBy("account_no", "account_name").agg(
        F.sum("n").alias("moves_total"),
        F.sum("n_recent").alias("moves_recent"),
        F.count("*").alias("journals"),
        F.min("first_at").alias("first_move"),
        F.max("last_at").alias("last_move"),
        F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"),
    )


def account_inventory(books: Books, rules: Rules, since: dt.date) -> DataFrame:
    """Considered accounts with recent movements: unit, label, counts, net, last movement."""
    activity = (
        account_activity(books, since)
        .withColumn("account_no", tx.canonical_account_no(F.col("account_no")))
        .groupBy("account_no")
        .agg(
            F.sum("moves_total").alias("moves_total"),
            F.sum("moves_recent").alias("moves_recent"),
            F.sum("journals").alias("journals"),
            F.max("last_move").alias("last_move"),
            F.sum("debit").alias("debit"),
            F.sum("credit").alias("credit"),
        )
        .filter(F.col("moves_recent") > 0)
    )
    policy = policy_preferred(books["account_policy"]).filter("considered")
    net = F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0))
    return activity.join(policy, "account_no").select(
        F.coalesce(cl.unit_of_name(F.upper("account_name"), rules), F.lit("Otras")).alias("unit"),
        "account_no",
        tx.account_label(F.col("account_name")).alias("label"),
        "moves_total",
        "moves_recent",
        "journals",
        net.alias("net"),
        pe.month_or_dash(F.col("last_move")).alias("last_month"),
    )


def inventory_totals(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("unit").agg(
        F.count("*").alias("accounts"), F.sum("moves_recent").alias("moves_recent"), F.sum("net").alias("net")
    )


def _selected(books: Books, rules: Rules, codes, since: dt.date | None, with_party: bool = False):
    accounts = books["account"].filter(F.col("class_code").isin(*codes))
    return postings(books, rules, accounts, since, with_party=with_party)


def date_shift_matrix(books: Books, rules: Rules, codes: tuple[str, ...]) -> DataFrame:
    """Accounting month x load month x account x side x origin: rows, total, closing, operating.

    Where the two months differ, the split row shows the shift.
    """
    rows = _selected(books, rules, codes, None)
    mark = f"(?i){rules.closing_text}"
    closing = tx.contains(F.col("detail"), mark)
    open_text = F.coalesce(~F.col("detail").rlike(mark), F.lit(False))
    return rows.groupBy(
        pe.month_text(F.col("accounting_at")).alias("accounting_month"),
        pe.month_text(F.col("loaded_at")).alias("load_month"),
        "account_no",
        "account_name",
        "side",
        "origin_code",
    ).agg(
        F.count("*").alias("n"),
        F.sum("amount").alias("total"),
        F.sum(F.when(closing, F.col("amount")).otherwise(F.lit(0))).alias("closing"),
        F.sum(F.when(open_text, F.col("amount")).otherwise(F.lit(0))).alias("operating"),
    )


def origin_distribution(books: Books, rules: Rules, codes: tuple[str, ...]) -> DataFrame:
    rows = _selected(books, rules, codes, None)
    rows = rows.withColumn("journal_id", _rekeyed("journal_id"))
    per_journal = rows.groupBy("origin_code", "side", "journal_id").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total")
    )
    return per_journal.groupBy("origin_code", "side").agg(
        F.sum("n").alias("n"), F.count("*").alias("journals"), F.sum("total").alias("total")
    )


def raw_sample(books: Books, rules: Rules, codes: tuple[str, ...], since: dt.date, n: int = 120) -> DataFrame:
    """First ``n`` postings by load date (top-n, no full sort); every column breaks ties."""
    rows = _selected(books, rules, codes, since, with_party=True)
    columns = ["loaded_at", "accounting_at", "account_no", "account_name", "side", "amount", "origin_code", "detail", "party"]
    return rows.select(*columns).orderBy(*columns).limit(n)


def unit_debit_credit(books: Books, rules: Rules) -> DataFrame:
    """Salary accounts: debit and credit by accounting month, load month and unit."""
    codes = [code for code, kind in rules.accrual_kinds.items() if kind == SALARIES]
    accounts = books["account"].filter(F.col("class_code").isin(*codes)).withColumn("unit", F.expr(rules.accrual_unit_sql))
    rows = postings(books, rules, accounts)
    return rows.groupBy(
        pe.month_text(F.col("accounting_at")).alias("accounting_month"),
        pe.month_text(F.col("loaded_at")).alias("load_month"),
        "unit",
    ).agg(_debit(F.col("amount")).alias("debit"), _credit(F.col("amount")).alias("credit"))


def noise_profile(books: Books, rules: Rules, codes: tuple[str, ...]) -> DataFrame:
    """Rows and totals by accounting month, account, side and noise category."""
    rows = _selected(books, rules, codes, None)
    category = cl.noise_category(F.col("origin_code"), F.col("detail"), rules)
    return rows.groupBy(
        pe.month_text(F.col("accounting_at")).alias("accounting_month"),
        "account_no",
        "account_name",
        "side",
        cl.decode(category, PROFILE_LABELS).alias("category"),
    ).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def noise_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("category", "side").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ledger_search(books: Books, rules: Rules, words: tuple[str, ...] | list[str], since: dt.date | None = None) -> DataFrame:
    """Postings of the parties whose name contains one of ``words``, in any case.

    The party list is filtered first; only postings of a hit meet the journal and the accounts.
    """
    parties = books["origin_party"].filter(tx.contains_any(F.col("party"), words))
    origin_on_line = "origin_id" in books["journal_line"].columns
    lines, journals = books["journal_line"], books["journal"]
    if origin_on_line:
        lines = lines.join(parties, "origin_id")
    else:
        journals = journals.join(parties, "origin_id")
    rows = lines.join(journals, "journal_id").filter(F.col("loaded_at") >= F.lit(since or rules.ledger_since))
    rows = rows.join(books["account"], "account_id", "left").withColumn("detail", F.expr(rules.detail_sql))
    return rows.select(
        "loaded_at", "origin_code", "amount", "side", "account_no", "account_name", "party", "detail"
    )


def party_search(books: Books, words: tuple[str, ...] | list[str]) -> DataFrame:
    """Distinct (name, id) of matching parties: one name may have many ids."""
    return (
        books["fiscal_party"]
        .filter(tx.contains_any(F.col("party"), words))
        .select("party", F.col("fiscal_id").cast("string").alias("fiscal_id"))
        .distinct()
    )


def capital_accounts(books: Books, rules: Rules, prefix: str = "1") -> DataFrame:
    """Debit movements of one account class, by account and origin."""
    accounts = books["account"].filter(F.col("account_no").startswith(prefix))
    rows = postings(books, rules, accounts).filter(F.col("side") == 0)
    return rows.groupBy("account_no", "account_name", "origin_code").agg(
        F.count("*").alias("n"), F.sum("amount").alias("total")
    )


def asset_monthly(
    books: Books, rules: Rules, prefix: str, start: dt.date, end: dt.date
) -> DataFrame:
    """The same by load month, over the half-open range [start, end)."""
    accounts = books["account"].filter(F.col("account_no").startswith(prefix))
    rows = postings(books, rules, accounts, start).filter((F.col("side") == 0) & (F.col("loaded_at") < F.lit(end)))
    return rows.groupBy(
        pe.month_text(F.col("loaded_at")).alias("month"), "account_no", "account_name", "origin_code"
    ).agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def liability_raw(books: Books, rules: Rules, start: dt.date, end: dt.date) -> DataFrame:
    """Liability salary postings over [start, end): every side, every text."""
    rows = _selected(books, rules, rules.liability_units, start).filter(F.col("loaded_at") < F.lit(end))
    return rows.select("loaded_at", "side", "amount", "account_no", "account_name", "detail", "origin_code")


def liability_history(books: Books, rules: Rules) -> DataFrame:
    rows = _selected(books, rules, rules.liability_units, None)
    return rows.groupBy(
        pe.month_text(F.col("loaded_at")).alias("month"), "account_no", "account_name", "side"
    ).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))


def latest_rates(books: Books, n: int = 30, by: str = "rate_id") -> DataFrame:
    """Last ``n`` rates by ``by`` (a date where the table has one)."""
    return books["fx_rate"].orderBy(F.col(by).desc(), F.col("rate").desc()).limit(n)


def last_months(frame: DataFrame, keys: list[str], n: int = 12) -> DataFrame:
    """The last ``n`` months of each series."""
    order = Window.partitionBy(*keys).orderBy(F.col("month").desc())
    return frame.withColumn("_row", F.row_number().over(order)).filter(F.col("_row") <= n).drop("_row")
