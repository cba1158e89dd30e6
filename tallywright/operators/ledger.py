"""Ledger: journal headers, lines, accounts and parties."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import periods as pe
from ..functions import text as tx
from ..rules import Rules
from ..schemas import Books
from .screen import screened


def account_names(accounts: DataFrame) -> DataFrame:
    """Accounts with their concept (title-cased name). Done on the dimension, not on postings."""
    return accounts.withColumn("concept", tx.title_case(F.trim("account_name")))


def ledger_fact(
    books: Books,
    rules: Rules,
    since: dt.date | None = None,
    accounts: DataFrame | None = None,
    with_party: bool = True,
) -> DataFrame:
    """The whole ledger, header first: a journal without lines gives one row of nulls.

    ``since`` is a floor on the load date. The party side is optional because Spark cannot drop
    an outer join it does not know to be one-to-one.
    """
    accounts = account_names(books["account"]) if accounts is None else accounts
    if "co_line" in books:
        fact = books["co_journal"].join(books["co_line"], "journal_id", "left").unionByName(books["hot_posting"])
    else:
        fact = books["journal"].join(books["journal_line"], "journal_id", "left")
    fact = _loaded_since(fact, since or rules.ledger_since)
    return _finish(fact.join(accounts, "account_id", "left"), books, rules, with_party)


def _loaded_since(rows: DataFrame, since: dt.date) -> DataFrame:
    """Rows loaded from a date on. Where files are laid out by load month, earlier months are not opened."""
    rows = rows.filter(F.col("loaded_at") >= F.lit(since))
    if "load_month" in rows.columns:
        rows = rows.filter(F.col("load_month") >= F.lit(f"{since:%Y-%m}")).drop("load_month")
    return rows


def journal_rows(books: Books, accounts: DataFrame) -> DataFrame:
    """Lines with account and journal: from the prepared posting table or the co-located tables if the books have them."""
    if "posting" in books:
        return books["posting"].join(accounts, "account_id")
    if "co_line" in books:
        cold = books["co_line"].join(accounts, "account_id").join(books["co_journal"], "journal_id")
        return cold.unionByName(books["hot_posting"].join(accounts, "account_id"))
    return books["journal_line"].join(accounts, "account_id").join(books["journal"], "journal_id")


def journal_lines(books: Books) -> DataFrame:
    """Lines with their journal, of all accounts."""
    if "posting" in books:
        return books["posting"]
    if "co_line" in books:
        return books["co_line"].join(books["co_journal"], "journal_id").unionByName(books["hot_posting"])
    return books["journal_line"].join(books["journal"], "journal_id")


def listed_rows(books: Books, accounts: DataFrame, journals: Column | None = None, lines: Column | None = None) -> DataFrame:
    """The rows of ``journal_rows`` with the account's texts joined last.

    Lines are cut by the bare ids of the list, which stay short enough to broadcast far longer than
    the texts would, and no text crosses the shuffle by journal. Lines that meet none of the ids are
    screened off before any shuffle, and, where ``journals`` (a test on journal columns) leaves journals
    out, those of other journals too. ``lines`` is a test on columns of a line and of one of its accounts.
    Books that keep lines and journals together need no such shuffle.
    """
    if "posting" in books or "co_line" in books:
        rows = journal_rows(books, accounts)
        tests = [t for t in (journals, lines) if t is not None]
        return rows.filter(reduce(and_, tests)) if tests else rows
    journal = books["journal"] if journals is None else books["journal"].filter(journals)
    found = screened(books["journal_line"], accounts, "account_id")
    if journals is not None:
        found = screened(found, journal, "journal_id")
    listed = accounts.withColumnRenamed("account_id", "listed_id")
    same = F.col("account_id") == F.col("listed_id")
    found = found.join(listed, same if lines is None else same & lines, "left_semi")
    return found.join(journal, "journal_id").join(accounts, "account_id")


def account_months(books: Books, rules: Rules, accounts: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Sum of the postings by account and load month, with the account's columns.

    For long account lists: sums are made by id, and the texts meet one row a month.
    """
    rows = _loaded_since(journal_lines(books), since or rules.ledger_since)
    sums = rows.groupBy("account_id", pe.month_of(F.col("loaded_at")).alias("month")).agg(F.sum("amount").alias("amount"))
    return sums.join(accounts, "account_id")


def prepare_postings(books: Books, path: str) -> Books:
    """Join lines and journal once, store the result, and give back books that read it.

    For a run of several products over the same ledger: the widest shuffle happens once. Files
    are laid out by load month and sorted by account, so date floors and account lists skip
    row groups. ``path`` belongs on shared storage.
    """
    joined = books["journal_line"].join(books["journal"], "journal_id")
    month = F.date_format("loaded_at", "yyyy-MM")
    laid_out = joined.withColumn("load_month", month).hint("rebalance", F.col("load_month"))
    laid_out.sortWithinPartitions("load_month", "account_id").write.mode("overwrite").partitionBy("load_month").parquet(path)
    spark = joined.sparkSession
    return books.replaced(posting=spark.read.schema(laid_out.schema).parquet(path))


def postings(
    books: Books,
    rules: Rules,
    accounts: DataFrame,
    since: dt.date | None = None,
    with_party: bool = False,
    by_accounting_date: bool = False,
    texts_last: bool = False,
    journals: Column | None = None,
    lines: Column | None = None,
) -> DataFrame:
    """Ledger rows of the selected ``accounts``.

    Lines meet the account list before they meet the journal, so the join on the journal id
    (the widest shuffle) only carries lines of interest, and a short list is broadcast by Spark
    once its size is known. With ``texts_last``, for lists that leave accounts out, lines meet only
    the list's ids there, and journals that fail the test ``journals`` and lines that fail ``lines`` are
    left out too.
    """
    fact = listed_rows(books, accounts, journals, lines) if texts_last else journal_rows(books, accounts)
    floor = since or rules.ledger_since
    fact = fact.filter(F.col("accounting_at") >= F.lit(floor)).drop("load_month") if by_accounting_date else _loaded_since(fact, floor)
    return _finish(fact, books, rules, with_party)


def _finish(fact: DataFrame, books: Books, rules: Rules, with_party: bool) -> DataFrame:
    if with_party:
        fact = fact.join(books["origin_party"], "origin_id", "left")
    return fact.withColumns(
        {
            "origin": cl.decode(F.col("origin_code"), rules.origin_labels),
            "detail": F.expr(rules.detail_sql),
        }
    )


def ledger_line_first(books: Books, rules: Rules, since: dt.date) -> DataFrame:
    """Result-account postings, line first, from an accounting date on.

    The filters on the header and the account make both joins inner, so they are written so.
    """
    accounts = account_names(books["account"]).filter(above_account(F.col("account_no"), rules.result_accounts_above))
    return postings(books, rules, accounts, since, by_accounting_date=True, texts_last=True)


def ledger_by_party(books: Books, rules: Rules, since: dt.date, movement_first: bool = False) -> DataFrame:
    """Result-account postings with the party of their movement.

    Line first keeps postings without a movement (null party); movement first does not.
    """
    rows = ledger_line_first(books, rules, since)
    party = books["movement"].join(
        books["fiscal_party"].select("fiscal_id", "party"), "fiscal_id", "left"
    ).drop("fiscal_id")
    return rows.join(party, "movement_id", "inner" if movement_first else "left")


def above_account(account_no: Column, bound: int) -> Column:
    """Numeric test on a text account number; text that is no number does not pass."""
    return account_no.try_cast("bigint") > bound


def result_line_filter(rows: DataFrame, rules: Rules) -> DataFrame:
    """Drop closing entries, depreciation concepts and excluded accounts; nulls stay."""
    return rows.filter(
        ~tx.contains(F.col("detail"), rules.closing_entry_text)
        & ~tx.contains(F.col("concept"), rules.excluded_concept_text)
        & ~F.coalesce(F.col("account_no").isin(*rules.excluded_accounts), F.lit(False))
    )
