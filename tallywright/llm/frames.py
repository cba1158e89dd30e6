"""Helpers the operators share: reading, tables in the shared folder, cutting work to size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session on one machine may do without: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="llm-shared-"))
    return _LOCAL[0]


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, whatever the case of letters."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_HELD: dict = {}


def held(key, make):
    """The one large object a worker process keeps between tasks; another one takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what earlier tasks of this worker process kept, before work that needs the memory."""
    _HELD.clear()


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The frame, computed once and kept as a table in the shared folder: later jobs read it, lost executors do no harm."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: the measure that group and shard counts follow."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def shards_for(total: int, each: int, least: int = 8) -> int:
    return max(least, -(-total // each))


def by_size(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each."""
    yield from _runs([len(t) for t in texts], limit)


def sliced(batch: pa.RecordBatch, limit: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The ranges of ``by_size`` as slices of a batch, without a copy: no more than one of them need be Python texts at a time."""
    sizes = pc.utf8_length(batch.column(batch.schema.get_field_index(name))).fill_null(0).to_pylist()
    for start, stop in _runs(sizes, limit):
        yield batch.slice(start, stop - start)


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def at_spaces(text: str, limit: int) -> list[str]:
    """Cut a text behind spaces into parts of at most ``limit`` characters; a longer run without a space stays whole."""
    if len(text) <= limit:
        return [text]
    parts, at = [], 0
    while len(text) - at > limit:
        cut = text.rfind(" ", at, at + limit)
        if cut < 0:
            cut = text.find(" ", at + limit)
            if cut < 0:
                break
        parts.append(text[at : cut + 1])
        at = cut + 1
    parts.append(text[at:])
    return parts


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with A-Z lowered, start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the text it is in."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    big = (data >= 65) & (data <= 90)
    data = data + (big.astype(np.uint8) << 5)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    return data, starts, ends, owner


_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_ODD, np.uint64(pow(int(_ODD), -1, 1 << 64)))):
            row = np.full(1 << n.bit_length(), base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row)
    return _POWERS


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


STRIP = 1 << 17


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums modulo two to the 64. Words are in order and do not overlap.

    Sums start anew every ``STRIP`` bytes, which no hash depends on; a longer word has a strip of its own.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        begin = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + STRIP, "right")))
        part = data[begin : int(ends[b - 1])]
        powers, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * powers[: len(part)], out=total[1:])
        first, last = starts[a:b] - begin, ends[a:b] - begin
        out[a:b] = mixed((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        a = b
    return out


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))


CHUNK = 1 << 16


def summed_cells(rows: DataFrame, count, cells: int) -> np.ndarray:
    """Element-wise sum over all tasks of the ``cells`` integers that ``count(batch)`` adds places of.

    A sketch of a fixed size: its sums reach the driver in ``cells / 65536`` rows, whatever the input.
    """

    def add(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += np.bincount(count(batch), minlength=cells)
        for k, v in cell_parts(total):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.binary())], names=["k", "v"])

    return merged_cells(rows.mapInArrow(add, "k int, v binary"), cells)


def cell_parts(total: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A task's sums as packed parts (first cell, counts); parts without a count are left out."""
    for k in range(0, len(total), CHUNK):
        part = total[k : k + CHUNK]
        if part.any():
            yield k, _packed(part)


def merged_cells(parts: DataFrame, cells: int) -> np.ndarray:
    """The sums over all parts ``k, v`` of all tasks."""

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) + _unpacked(v)
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(v)], pa.binary())], names=["k", "v"])

    out = np.zeros(cells, np.int64)
    for r in parts.repartition(8, "k").mapInArrow(merge, "k int, v binary").collect():
        out[r.k : r.k + min(CHUNK, cells)] = _unpacked(r.v)
    return out


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest width that holds them; the first byte names it."""
    for width, kind in ((1, np.uint8), (2, np.uint16), (4, np.uint32), (8, np.int64)):
        if int(counts.max()) <= np.iinfo(kind).max:
            return bytes([width]) + counts.astype(kind).tobytes()
    raise OverflowError


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[packed[0]], offset=1).astype(np.int64)


def stars(links: DataFrame) -> DataFrame:
    """``node, root`` (the least node reachable) of every node in the undirected links ``a, b``, but for the roots themselves.

    Large-star and small-star rounds: each hangs neighbours on the least node known, by joins and map-side
    minima, and is stored, so no node's neighbours are ever collected. Links that are stars take no round.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct edges ``a > b`` hangs on one node, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1 and up > 0").count() == 0
