"""Pack token sequences into as few fixed-size sequences as possible.

What has to be decided depends on lengths alone, and there are at most ``capacity`` of them, so packing
works on the counts of lengths: first the Martello-Toth reduction fixes bins that provably belong to
some best packing, then the rest is packed best-fit, longest first. The outcome is a short list of
patterns (which lengths share a sequence, how many such sequences). Pieces take their places in the
patterns by their number among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import at_spaces, by_size, stored, texts_of
from .transducer import transducer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Stock:
    """Counts of lengths, with the largest length up to a bound and the smallest ones."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] += n

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.count[: max(most, 0) + 1])
        return int(found[-1]) if len(found) else 0

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for length in np.flatnonzero(self.count)[:n].tolist():
            out += [length] * min(n - len(out), int(self.count[length]))
            if len(out) >= n:
                break
        return out

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.count[length] -= times


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction: bins fixed for good, and the counts that are left.

    For the longest piece not yet settled, a set holding it is fixed when no other set with it can be
    better: nothing else fits beside it; one other fills the bin exactly; at most one other fits, and it
    is the largest that does; at most two others fit, and the largest single one is at least as long as
    the longest pair that fits.
    """
    stock, fixed = _Stock(counts, capacity), []
    length = stock.largest(capacity)
    while length:
        have = int(stock.count[length])
        room = capacity - length
        stock.count[length] -= 1  # beside itself it is one of the others
        other = stock.largest(room)
        few = stock.smallest(3)
        stock.count[length] += 1
        fits = sum(1 for t in np.cumsum(few) if t <= room)
        if not other:
            times = have if length * 2 > capacity or have == 1 else 1
            fixed.append(((length,), times))
            stock.take((length,), times)
        elif other == room or fits <= 1 or (fits == 2 and other >= _longest_pair(stock, room, length)):
            # taking pieces only makes less fit beside the next one, so the test holds until one of the lengths is used up
            times = have // 2 if other == length else min(have, int(stock.count[other]))
            fixed.append(((length, other), times))
            stock.take((length, other), times)
        else:
            length = stock.largest(length - 1)
            continue
        length = stock.largest(length)
    return fixed, {int(k): int(stock.count[k]) for k in np.flatnonzero(stock.count)}


def _longest_pair(stock: _Stock, room: int, length: int) -> int:
    """Length of the longest pair that fits beside one piece of ``length``."""
    count = stock.count.copy()
    count[length] -= 1
    have = np.flatnonzero(count[: room + 1])
    i, j, best = 0, len(have) - 1, 0
    while i <= j:
        total = int(have[i] + have[j])
        if total > room or (i == j and count[have[i]] < 2):
            j -= 1
        else:
            best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, for all pieces of one length at a time."""
    open_bins: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room left
    rooms = np.zeros(capacity + 1, bool)
    done: Counter = Counter()
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                per = capacity // length
                full, rest = divmod(left, per)
                for n, times in ((per, full), (rest, 1 if rest else 0)):
                    if times:
                        room = capacity - n * length
                        bins = open_bins[room]
                        bins[(length,) * n] = bins.get((length,) * n, 0) + times
                        rooms[room] = True
                break
            room = length + int(fit[0])
            bins = open_bins[room]
            pattern, times = next(iter(bins.items()))
            used = min(times, left)
            if used == times:
                del bins[pattern]
                rooms[room] = bool(bins)
            else:
                bins[pattern] = times - used
            left -= used
            new = (*pattern, length)
            if room == length:
                done[new] += used
            else:
                at = open_bins[room - length]
                at[new] = at.get(new, 0) + used
                rooms[room - length] = True
    for bins in open_bins:
        done.update(bins)
    return list(done.items())


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first number, first sequence, offset), by number."""
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in packed:
        offset = 0
        for length in pattern:
            rows.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, path: str, *, capacity: int, end_id: int, slice_chars: int = 800_000) -> DataFrame:
    """Pieces of each document's ids, an end id included; numbered by task and length."""

    def cut(batches):
        machine = transducer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, ids = texts_of(batch), batch.column(0).to_pylist()
            for a, b in by_size(texts, slice_chars):
                spans = [at_spaces(t, slice_chars) for t in texts[a:b]]
                if all(len(s) == 1 for s in spans):
                    n, tokens = machine.encode(texts[a:b], True)
                else:
                    n, found = [], []
                    for s in spans:
                        each = [machine.encode([x], True) for x in s]
                        n.append(sum(int(k[0]) for k, _ in each))
                        found += [t for _, t in each]
                    n, tokens = np.array(n), np.concatenate(found)
                tokens = np.insert(tokens.astype("<u4"), np.cumsum(n), end_id)  # an end behind each document
                ends = np.cumsum(n + 1)
                rows: list[list] = [[], [], [], [], []]
                for i, (end, size) in enumerate(zip(ends.tolist(), (n + 1).tolist())):
                    for k, start in enumerate(range(0, size, capacity)):
                        length = min(capacity, size - start)
                        at = end - size + start
                        for column, value in zip(rows, (ids[a + i], k, start, length, zlib.crc32(tokens[at : at + length]))):
                            column.append(value)
                length = np.array(rows[3], np.int64)
                # number among the pieces of equal length that this task has cut
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order], "left")
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(length), pa.array(rows[4], pa.int64()),
                        pa.array(np.full(len(length), part, np.int32)), pa.array(rank),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Documents longer than ``capacity`` ids (end id included) are cut, others stay whole. A null text is
    empty and packs as its end id alone. A null ``doc_id`` stays null, repeated rows are packed each,
    other columns are not read. An empty table gives no rows. Only the counts of lengths, at most
    ``capacity`` rows, come to the driver, and the places it works out are as bounded.
    """
    cut = stored(pieces(docs, path, capacity=capacity, end_id=end_id), "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    places = slots(patterns(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for value, rows in zip(values.tolist(), np.split(order, first[1:])):
                table = places[value]
                at = np.searchsorted(table[:, 0], number[rows], "right") - 1
                sequence[rows] = table[at, 1] + number[rows] - table[at, 0]
                offset[rows] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    found = cut.join(numbered, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("number"))
    return found.mapInArrow(place, PLACED)
