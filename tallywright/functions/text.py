"""Text: account numbers, labels, title case, cleaning."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` only looks at blanks, so ``BS.AS.`` and ``AGUA-LUZ`` come out different. The
    lambda keeps this out of generated code: apply it to dimensions, not to ledger rows.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substr(run, F.lit(2)))), ""
    )


def canonical_account_no(number: Column) -> Column:
    """``'42101001.0'`` and ``' 42101001 '`` become ``'42101001'``; other text is trimmed."""
    text = number.cast("string")
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), F.trim(text))


def matches(text: Column, pattern: str) -> Column:
    """Pattern test. A pattern that is only words and ``|`` runs as plain substring tests."""
    words = pattern.split("|")
    if not all(word and re.escape(word).replace("\\ ", " ") == word for word in words):
        return text.rlike(pattern)
    test = text.contains(words[0])
    for word in words[1:]:
        test = test | text.contains(word)
    return test


def contains(text: Column, pattern: str) -> Column:
    """Pattern test that is false, not null, on null text."""
    return F.coalesce(matches(text, pattern), F.lit(False))


def contains_any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Case-insensitive substring search for any of ``words`` (null text: false)."""
    test = F.lit(False)
    for word in words:
        test = test | F.coalesce(text.ilike(f"%{word}%"), F.lit(False))
    return test


def strip_control(text: Column) -> Column:
    """Drop the control characters that spreadsheets refuse. Null stays null."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")


def decode_bytes(value: Column) -> Column:
    """Text of a binary column, as some database drivers deliver labels."""
    return F.decode(value, "UTF-8")


def strip_bytes_mark(text: Column) -> Column:
    """``b'2026-01'`` becomes ``2026-01``; a byte-order mark in front goes too."""
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "^b'|'$", "")


def account_label(name: Column) -> Column:
    """Name without its regional prefix, cut to 52 characters, in title case."""
    bare = F.regexp_replace(F.trim(name), "(?i)^(BSAS|BS AS|PAT|SALTA) ", "")
    cut = F.when(F.length(bare) > 52, F.concat(F.rtrim(F.substring(bare, 1, 51)), F.lit("…"))).otherwise(bare)
    return title_case(cut)


def concept_label(concept: Column) -> Column:
    """Concept without its ordering prefix (everything up to the first hyphen)."""
    return F.when(concept.contains("-"), F.trim(F.regexp_replace(concept, "^[^-]*-", ""))).otherwise(concept)


def short_label(text: Column, width: int = 45) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)
