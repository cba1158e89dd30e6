"""From raw documents to packed training sequences: the stages of the corpus pipeline.

Every stage takes an empty table, keeps the columns it is given (the last one gives pieces) and reads none
but ``doc_id``, ``text`` and, where it says so, ``lang``; other columns may have any name. Ties go to the
lesser id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import decontaminate, jaccard_join, language, packing, secret_ledger
from tallywright.llm.catalog import held_out
from tallywright.llm.frames import stored, table

TOKENIZER = "word_bpe_49k.json"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which half the letters or more are in one learned language; ``lang`` is set to it.

    Learned from rows with text and ``lang`` that are not held out. Null, empty and letterless texts go;
    repeated rows and rows without an id are judged each like any other.
    """
    model = language.learn(docs.where(~held_out(5, 0)))
    return language.with_language(docs, model, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Of repeated rows one stays. Rows without an id stay, linked or not; a text without words is linked to
    none.
    """
    return jaccard_join.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaked benchmark items.

    Null and empty texts leak nothing and stay; repeated rows and rows without an id are judged each.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and ``n_chars``, where there is one, set anew.

    A null text stays null; repeated rows are changed alike.
    """
    return secret_ledger.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens.

    A null text is empty: its piece is the end token alone. Repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=4096, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("best_fit_packing", best_fit_packing),
]

# Language identification, packing and searching are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is stored and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
