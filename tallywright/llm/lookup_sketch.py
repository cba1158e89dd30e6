"""Document fingerprints: invertible Bloom lookup sketches over paragraph cells.

A text is a set of paragraph digests (lines, long lines in parts). A sketch puts every digest into one
cell of each of three subtables; a cell keeps a count, the xor of its digests and the xor of their
checks. Two sketches of equal size subtract cell by cell, digests that both texts have cancel out, and
peeling recovers the rest: a cell with a single digest gives it away, which is then taken out of its
other cells. The fingerprint is a sketch of 3 x 8 cells. Where its difference doesn't peel, the same
digests in a larger sketch, sized by the two texts, are tried; the cells of the small sketch are sums of
those of the large one. What even that leaves is decided on the digests themselves.

Everything here is DataFrame functions. Rows of one document stay in one partition from the join of the
texts on, so the aggregations over cells need no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBTABLES = 3
SMALL = 8  # cells of a subtable of the fingerprint
PART = 96  # characters of a paragraph cell at most
ROUNDS = 15


def paragraph_digests(text: Column, part: int = PART) -> Column:
    """The distinct digests of a text's lines; longer lines are cut into parts of ``part`` characters."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{part}}}\n?|\n"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def _cell(digest: Column, table: Column, size: Column) -> Column:
    return F.xxhash64(digest, table).bitwiseAND(size - 1).cast("int")


def _check(digest: Column) -> Column:
    return F.hash(digest, F.lit(7)).cast("long").bitwiseAND(0xFFFF)


def next_by_id(docs: DataFrame, key: str) -> DataFrame:
    """``key, next_key``: the next smaller key, and for the smallest the largest. No task sees all keys.

    Keys are sorted in ranges; the largest key of each range below joins the ranges up.
    """
    keys = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    ranges = keys.repartitionByRange("k").select("k", F.spark_partition_id().alias("range"))
    # one row for each range: at most as many as there are partitions
    ends = ranges.groupBy("range").agg(F.max("k").alias("top"))
    order = Window.orderBy("range")
    below = ends.select("range", F.coalesce(F.lag("top").over(order), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("wrap"))
    inside = Window.partitionBy("range").orderBy("k")
    chained = ranges.withColumn("next", F.lag("k").over(inside)).join(below, "range")
    return chained.select(F.col("k").alias(key), F.coalesce("next", "wrap").alias(f"next_{key}"))


def _edited_rows(docs: DataFrame) -> DataFrame:
    """``id, void, copy, n_chars, edited_sha256`` and the digests of the text, of the edited text and of the next document.

    ``void`` marks rows without an id; ``copy`` numbers rows of equal id, below zero for those. Texts are
    dealt out by ``id`` once; every row stays there in all that follows.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("void"), F.coalesce(F.col("text"), F.lit("")).alias("text")).repartition("id")
    number = F.row_number().over(Window.partitionBy("id", "void").orderBy("text"))
    rows = texts.withColumn("copy", F.when(F.col("void"), -number).otherwise(number))
    known = docs.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "id")
    sizes = known.groupBy("id").agg(F.max(F.char_length("text")).alias("widest"))
    wanted = next_by_id(known, "id").join(sizes, "id").select(
        F.col("id").alias("target"), F.col("next_id").alias("id"), F.coalesce(F.floor(F.col("widest") / 2), F.lit(0)).cast("int").alias("take")
    )
    # written so that no filter slips below the exchange, which both uses of the texts share
    first = F.abs(F.col("copy") - 1) < 1
    heads = rows.join(wanted, "id").where(first).select(F.col("target").alias("id"), F.left("text", "take").alias("head"), paragraph_digests(F.col("text")).alias("next"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    head = F.when(~F.col("void"), F.left("head", half))
    edited = F.concat(F.left("text", F.char_length("text") - half), F.coalesce(head, F.lit("")))
    joined = rows.join(heads, "id", "left").withColumn("edited", edited)
    return joined.select(
        "id", "void", "copy", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"), paragraph_digests(F.col("edited")).alias("edit"),
        F.coalesce(F.when(~F.col("void"), F.col("next")), F.array().cast("array<bigint>")).alias("next"),
    )


def _cells(rows: DataFrame) -> DataFrame:
    """Cells of all sketches of a row. ``kind``: a, e fingerprints of the text and the edited one; E0, E1, N0, N1 differences, small and large."""
    most = F.size("own") + F.greatest(F.size("edit"), F.size("next"))
    # a power of two of at least half the digests: three subtables hold them all with room to peel
    size = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(most / 2 + 1)), F.lit(3))).cast("long")
    tag = lambda column, v: F.transform(column, lambda x: F.struct(F.lit(v).alias("v"), x.alias("x")))
    tagged = F.concat(tag("own", 0), tag("edit", 1), tag("next", 2))
    flat = rows.select("id", "copy", size.alias("size"), F.explode(tagged).alias("t"))
    flat = flat.select("id", "copy", "size", F.col("t.v").alias("v"), F.col("t.x").alias("x"), _check(F.col("t.x")).alias("c"))
    flat = flat.withColumn("table", F.explode(F.array(*(F.lit(j) for j in range(SUBTABLES)))))
    flat = flat.withColumn("cell", _cell(F.col("x"), F.col("table"), F.col("size")))
    zero = F.lit(0).cast("long")
    aggs = []
    for v, name in enumerate("aen"):
        own = F.col("v") == v
        aggs += [F.count(F.when(own, 1)).alias(f"n{name}"), F.bit_xor(F.when(own, F.col("x")).otherwise(zero)).alias(f"x{name}"), F.bit_xor(F.when(own, F.col("c")).otherwise(zero)).alias(f"c{name}")]
    large = flat.groupBy("id", "copy", "size", "table", "cell").agg(*aggs)

    def cell(kind: str, at: Column, size: Column, n: Column, x: Column, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), at.alias("cell"), size.alias("size"), n.alias("n"), x.alias("x"), c.alias("c"))

    small, eight = F.col("cell").bitwiseAND(SMALL - 1), F.lit(SMALL).cast("long")
    made = [cell("a", small, eight, F.col("na"), F.col("xa"), F.col("ca")), cell("e", small, eight, F.col("ne"), F.col("xe"), F.col("ce"))]
    for kind, o in (("E", "e"), ("N", "n")):
        minus = (F.col("na") - F.col(f"n{o}"), F.col("xa").bitwiseXOR(F.col(f"x{o}")), F.col("ca").bitwiseXOR(F.col(f"c{o}")))
        made += [cell(f"{kind}0", small, eight, *minus), cell(f"{kind}1", F.col("cell"), F.col("size"), *minus)]
    out = large.select("id", "copy", "table", F.explode(F.array(*made)).alias("m")).select("id", "copy", "table", "m.*")
    return _merged(out.withColumn("sign", F.lit(0)))


def _merged(cells: DataFrame) -> DataFrame:
    """Cells of one place added up. ``sign`` other than 0: not a cell but recovered digests, counted in ``n``."""
    summed = cells.groupBy("id", "copy", "kind", "sign", "table", "cell", "size").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
    return summed.where((F.col("n") != 0) | (F.col("x") != 0) | (F.col("c") != 0))


def _peeled(cells: DataFrame, table: int) -> DataFrame:
    """Take out what single cells of one subtable give away; a digest has one cell there, so none is taken twice."""
    single = (F.col("sign") == 0) & ~F.col("kind").isin("a", "e") & (F.col("table") == table) & (F.abs("n") == 1) & (_check(F.col("x")) == F.col("c"))
    here = F.struct("sign", "table", "cell", "size", "n", "x", "c")
    zero = F.lit(0).cast("long")
    out = [
        F.struct(F.lit(0).alias("sign"), F.lit(j).alias("table"), _cell(F.col("x"), F.lit(j), F.col("size")).alias("cell"), F.col("size"), (-F.col("n")).alias("n"), F.col("x"), F.col("c"))
        for j in range(SUBTABLES) if j != table
    ]
    found = F.struct(F.col("n").cast("int").alias("sign"), F.lit(0).alias("table"), F.lit(0).alias("cell"), F.col("size"), F.lit(1).cast("long").alias("n"), zero.alias("x"), zero.alias("c"))
    rows = F.when(single, F.array(found, *out)).otherwise(F.array(here))
    return _merged(cells.select("id", "copy", "kind", F.explode(rows).alias("m")).select("id", "copy", "kind", "m.*"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by as many of the next
    document by falling ``doc_id`` (after the last, the first). Likeness is the share of common
    paragraph digests, 1 for two texts without any. A null text is empty. Rows that repeat a ``doc_id``
    are reported each; the next document is the least text under the next smaller id. A null ``doc_id``
    has no next document: its last half is removed. Other columns are not read; an empty table gives no
    rows.
    """
    rows = _edited_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    cells = reduce(lambda c, k: _peeled(c, k % SUBTABLES), range(ROUNDS), _cells(rows))
    mark = F.concat(F.lpad(F.hex(F.col("n")), 4, "0"), F.lpad(F.hex("x"), 16, "0"), F.lpad(F.hex("c"), 4, "0"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("table", "cell", mark.alias("mark")))))
    sums = []
    for kind in ("E0", "E1", "N0", "N1"):
        sums += [F.sum(F.when((F.col("kind") == kind) & (F.col("sign") != 0), F.col("n"))).alias(f"d{kind}"), F.count(F.when((F.col("kind") == kind) & (F.col("sign") == 0), 1)).alias(f"left{kind}")]
    done = cells.groupBy("id", "copy").agg(of("a").alias("a"), of("e").alias("e"), *sums)
    # copies are compared as numbers, not as join keys: by ``id`` alone all rows are in place
    done = done.withColumnsRenamed({"id": "of", "copy": "of_copy"})
    joined = rows.join(done, (F.col("id") == F.col("of")) & (F.abs(F.col("copy") - F.col("of_copy")) < 1), "left")

    def string(cells: Column) -> Column:
        # cells without digests are left out, so the places of the others are written down
        return F.coalesce(F.array_join(F.transform(cells, lambda c: F.concat(c["table"], c["cell"], F.lit("."), c["mark"])), "-"), F.lit(""))

    def near(kind: str, other: str) -> Column:
        apart = F.size(F.array_except("own", other)) + F.size(F.array_except(other, "own"))
        differ = F.when(F.col(f"left{kind}0") == 0, F.coalesce(f"d{kind}0", F.lit(0))).when(F.col(f"left{kind}1") == 0, F.coalesce(f"d{kind}1", F.lit(0))).otherwise(apart)
        total = F.size("own") + F.size(other)
        return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))

    return joined.select(
        F.when(~F.col("void"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        string(F.col("a")).alias("fingerprint"), string(F.col("e")).alias("edited_fingerprint"), near("E", "edit").alias("near_edited"), near("N", "next").alias("near_next"),
    )
