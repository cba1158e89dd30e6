"""Source divergence audit over run-length columns.

Every (language, source) group is a column of counts over the kept vocabulary of its language. The
vocabulary is put in the order of the terms' count vectors, so that equal counts stand together; terms with
equal vectors fall into one entry with a weight. Each column is then a list of runs, and two columns are
compared run by run: between two boundaries of either column nothing changes, so the divergence of one term
times the length of the run is the share of the whole run.

The ordered vocabulary is dealt to tasks in ranges; runs are intersected in each and the sums of the ranges
are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_size, stored

# Bytes of terms, A-Z lowered, and spaces for all others: in UTF-8 only letters of ASCII are below 0x80 in a term.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNIT = 1_000_000_000


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of UTF-8 texts, one after the other, and the text each is in."""
    data = np.frombuffer(b" ".join(texts).translate(FOLDED) + b" ", np.uint8)
    solid = data != 32
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, begin)))
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])]), owner


def counted(texts: list[bytes], groups: list[tuple[str, str]]) -> pa.RecordBatch:
    """``lang, source, term, n, d`` of some texts and the (language, source) of each."""
    names = list(dict.fromkeys(groups))
    number = {g: i for i, g in enumerate(names)}
    group = np.array([number[g] for g in groups], np.int64)
    terms, owner = terms_of(texts)
    coded = terms.dictionary_encode()
    width, index = max(1, len(coded.dictionary)), coded.indices.to_numpy()
    cell, n = np.unique(group[owner] * width + index, return_counts=True)
    once = np.sort(owner * width + index)
    once = once[np.diff(once, prepend=-1) > 0]  # one of each text and term
    d = np.unique(group[once // width] * width + once % width, return_counts=True)[1]
    of = [pa.array([g[i] for g in names], pa.string()).take(pa.array(cell // width)) for i in range(2)]
    term = coded.dictionary.take(pa.array(cell % width)).cast(pa.string())
    return pa.RecordBatch.from_arrays([*of, term, pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "d"])


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = 16_000_000) -> DataFrame:
    """``lang, source, term, n`` (occurrences) and ``d`` (documents it is in), added up in slices of whole texts before they travel.

    Rows are dealt by language and term, so that sums over the sources need no other shuffle.
    """

    def count(batches):
        for batch in batches:
            langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
            groups = list(zip(langs, sources))
            for a, b in by_size(texts, slice_bytes):
                yield counted(texts[a:b], groups[a:b])

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "body"))]
    asked = docs.select(*named[:2], named[2].cast("binary").alias("body"))
    rows = asked.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_vocabulary(counts: DataFrame, least_documents: int = 3) -> DataFrame:
    """``lang, term, n, vector`` of the terms in enough documents of a language: occurrences, and the (source, count) entries."""
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return rows.where(F.col("d") >= least_documents).select("lang", "term", "n", "vector")


def entries_of(vocabulary: DataFrame) -> DataFrame:
    """``lang, term, n, source, own``: one row for each count above 0."""
    return vocabulary.select("lang", "term", "n", F.explode("vector").alias("e")).select("lang", "term", "n", F.col("e.source").alias("source"), F.col("e.n").alias("own"))


def group_totals(docs: DataFrame, vocabulary: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, total, lang_total, terms`` of every group that occurs: occurrences of kept terms there and in the language, and number of kept terms."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    own = entries_of(vocabulary).groupBy("lang", "source").agg(F.sum("own").alias("total"))
    whole = vocabulary.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    found = every.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return found.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")))


# ---------------------------------------------------------------------- runs
def chances(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """Smoothed chance of a count, in parts of ``UNIT``, exact at every size."""
    return np.array([1 + UNIT * (c + 1) // (total + terms) for c in counts.tolist()], np.int64)


def run_columns(entry: np.ndarray, column: np.ndarray, count: np.ndarray, entries: int, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of ``width`` columns, where its runs begin among the entries, and the count of each run.

    ``entry``, ``column`` and ``count`` are the cells above 0; all other cells are runs of 0.
    """
    order = np.lexsort((entry, column))
    entry, column, count = entry[order], column[order], count[order]
    edges = np.searchsorted(column, np.arange(width + 1))
    out = []
    for left, right in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at, value = entry[left:right], count[left:right]
        # a cell begins a stretch at its place; where no cell follows at once, zeros begin behind it
        behind = at[np.append(np.diff(at) != 1, True)[: len(at)]] + 1
        begin = np.concatenate([at, behind[behind < entries], [0] if not len(at) or at[0] else []]).astype(np.int64)
        held = np.zeros(len(begin), np.int64)
        held[: len(at)] = value
        by_place = np.argsort(begin)
        begin, held = begin[by_place], held[by_place]
        change = np.append(True, held[1:] != held[:-1])
        out.append((begin[change], held[change]))
    return out


def divergence(mine: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], before: np.ndarray) -> tuple[int, int]:
    """Sum of (p - q)^2 / q, rounded down for each term, of two columns of runs, and the same the other way round.

    ``before`` holds the number of terms before each entry and at last of all. From one boundary of either
    column to the next neither changes, so one term's value counts as often as the stretch has terms.
    """
    (a, p), (b, q) = mine, other
    bounds = np.union1d(a, b)
    length = np.diff(before[np.append(bounds, len(before) - 1)])
    p, q = p[np.searchsorted(a, bounds, "right") - 1], q[np.searchsorted(b, bounds, "right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of all ordered pairs of sources over one range of the vocabulary of one language."""
    made: tuple[list, list, list] = [], [], []
    lang = None
    if left.num_rows and right.num_rows:
        lang, terms = right.column("of")[0].as_py(), right.column("terms")[0].as_py()
        listed = right.column("groups")[0].as_py()
        names = [g["source"] for g in listed]
        left = left.sort_by("place")
        vectors = left.column("vector").combine_chunks()
        cells = vectors.flatten()
        sizes = np.diff(vectors.offsets.to_numpy())
        column = pc.index_in(cells.field("source"), value_set=pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(left.column("same").to_numpy())])
        runs = run_columns(np.repeat(np.arange(len(sizes)), sizes), column, cells.field("n").to_numpy(zero_copy_only=False), len(sizes), len(names))
        columns = []
        for (begin, value), g in zip(runs, listed):
            known, back = np.unique(value, return_inverse=True)
            columns.append((begin, chances(known, g["total"], terms)[back]))
        for i in range(len(names)):
            for j in range(i):
                for value, x, y in zip(divergence(columns[i], columns[j], before), (i, j), (j, i)):
                    made[0].append(names[x])
                    made[1].append(names[y])
                    made[2].append(value)
    return pa.table([pa.array([lang] * len(made[0]), pa.string()), *(pa.array(m, t) for m, t in zip(made, (pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "item", "value"])


def pair_values(vocabulary: DataFrame, totals: DataFrame, *, entries: int = 20_000) -> DataFrame:
    """``lang, source, item, value``: every group against every other source of its language.

    Terms with equal vectors are one entry. The entries of all languages are sorted by language and vector
    and cut into ranges of about ``entries``; a task builds the runs of its range and sends one sum a pair.
    """
    vectors = stored(vocabulary.groupBy("lang", "vector").agg(F.count("*").alias("same")), "count-vectors")
    parts = max(1, -(-vectors.count() // entries))
    order = ["lang", F.size("vector").desc(), "vector"]
    ranges = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumns({"shard": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "vocabulary-order")
    listed = totals.groupBy("lang", "terms").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"))
    asked = ranges.select("lang", "shard").distinct().join(listed, "lang").withColumnsRenamed({"lang": "of", "shard": "at"})
    shards = ranges.groupBy("lang", "shard").cogroup(asked.groupBy("of", "at"))
    sums = shards.applyInArrow(_compare, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = totals.select("lang", F.col("source").alias("item"))
    pairs = totals.select("lang", "source").join(others, "lang").where("source != item")
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def term_values(vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the kept terms that a group has more of than its language."""
    rows = entries_of(vocabulary).join(totals, ["lang", "source"])
    # products of counts and UNIT may need more than 64 bits
    chance = "1 + (CAST({} + 1 AS DECIMAL(19,0)) * CAST(1000000000 AS DECIMAL(10,0))) div CAST({} + terms AS DECIMAL(19,0))"
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(chance.format("own", "total")).alias("p"), F.expr(chance.format("n", "lang_total")).alias("q"))
    return rows.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = 3, most_terms: int = 200, entries: int = 20_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which terms.

    Part ``pair`` has a row for every other source, part ``term`` the first ``most_terms`` terms; ranks run by
    value, greatest first, and by item. A null text, language or source is the empty text. A group without
    kept terms is compared like any other; in a language without kept terms every value is 0; a lone source
    has no pairs. Repeated rows count each; ids and other columns are not read; an empty table gives no rows.
    """
    vocabulary = stored(kept_vocabulary(term_counts(docs, text=text, lang=lang, source=source), least_documents), "kept-vocabulary")
    totals = stored(group_totals(docs, vocabulary, lang=lang, source=source), "group-totals")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(vocabulary, totals, entries=entries).withColumn("rank", rank)
    terms = term_values(vocabulary, totals).withColumn("rank", rank).where(F.col("rank") <= most_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
