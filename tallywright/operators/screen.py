"""Rows cut before a wide shuffle by a filter of fixed size over the keys they are going to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 64 bits each: 4 MB of bits and at most half a million short rows to broadcast, whatever the input
WORDS = 1 << 19
WORD, MASK, BITS = "_word", "_mask", "_bits"
EXACT = (T.LongType(), T.IntegerType(), T.StringType())


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS))


def _mask(key: Column) -> Column:
    """Two bits of the word."""
    one, h = F.lit(1).cast("long"), F.xxhash64(key)
    first, second = (F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int") for n in (58, 52))
    return F.call_function("shiftleft", one, first).bitwiseOR(F.call_function("shiftleft", one, second))


def screened(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none whose key is there is lost.

    A Bloom filter in DataFrame functions. An inner or semi join with ``wanted`` on the key has still to
    follow: the more keys are wanted, the more others pass. Keys of two types, or of one in which equal
    values may hash apart, are not screened.
    """
    kind = rows.schema[key].dataType
    if kind != wanted.schema[key].dataType or kind not in EXACT:
        return rows
    bits = wanted.groupBy(_word(F.col(key)).alias(WORD)).agg(F.bit_or(_mask(F.col(key))).alias(BITS))
    marked = rows.withColumns({WORD: _word(F.col(key)), MASK: _mask(F.col(key))}).join(F.broadcast(bits), WORD)
    return marked.filter(F.col(BITS).bitwiseAND(F.col(MASK)) == F.col(MASK)).drop(WORD, MASK, BITS)
