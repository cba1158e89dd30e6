"""Fill-in-middle transformation over a learned rank index of code-point boundaries.

Texts stay UTF-8 bytes. A cut is asked for in code points, so what is wanted is the byte at which the
k-th code point begins. The index fits straight segments to all (rank, byte) pairs of a text, none of which
misses its segment by more than ``BOUND`` bytes, and keeps one signed byte of residual for each boundary:
a cut is predicted from its segment and then put right, exactly, by its residual. No text is searched twice
and no list of offsets is kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_size

# Greatest distance of a boundary from its segment when it is fitted; rounding adds two at most, and a
# residual is one signed byte.
BOUND = 120
# Slopes are whole numbers of 2^-30 bytes a code point.
SCALE = 30

PLAIN, PSM, SPM = "plain", "psm", "spm"
# Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


# Boundaries are fitted in pieces of at most this many bytes, so that fitting a long text takes little memory.
PIECE = 1 << 20


@dataclass
class RankIndex:
    """Byte of every code-point boundary of a batch of texts, as segments and residuals.

    A text is one piece or, beyond ``PIECE`` bytes, several; each piece has a boundary for each of its
    code points and one for its end. Boundaries are numbered through the batch: those of piece ``p`` begin
    at ``first[p]``, and ``before[p]`` code points stand before it. ``pieces[i]`` is the first piece of
    text ``i``. ``knot`` is the boundary at which each segment begins, ``base`` its byte, ``slope`` its
    steepness.
    """

    pieces: np.ndarray
    first: np.ndarray
    before: np.ndarray
    knot: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, data: np.ndarray, ends: np.ndarray, bound: int = BOUND, piece: int = PIECE) -> RankIndex:
        """Index of the texts that end at ``ends`` in ``data``, one behind the other."""
        stops, each = _cut(data, np.asarray(ends, np.int64), piece)
        parts, known, begin, p = [], 0, 0, 0
        while p < len(stops):
            q = max(p + 1, int(np.searchsorted(stops, begin + piece, "right")))
            part = cls._fit(data[begin : stops[q - 1]], stops[p:q] - begin, bound)
            parts.append((part[0], part[1] + known, part[2] + begin, part[3], part[4]))
            known, begin, p = known + len(part[4]), int(stops[q - 1]), q
        points, knot, base, slope, residual = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
        before = np.concatenate([[0], np.cumsum(points)])
        return cls(np.concatenate([[0], np.cumsum(each)]), before[:-1] + np.arange(len(points)), before, knot, base, slope, residual)

    @staticmethod
    def _fit(data: np.ndarray, ends: np.ndarray, bound: int):
        """Code points of each piece, first boundary, byte and slope of each segment, and all residuals."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.diff(np.searchsorted(lead, np.concatenate([[0], ends])))
        first = np.concatenate([[0], np.cumsum(points + 1)])
        at = np.empty(int(first[-1]), np.int64)
        closing = np.zeros(len(at), bool)
        closing[first[1:] - 1] = True
        at[~closing] = lead
        at[closing] = ends
        knot, slope = _segments(at, first, bound)
        base = at[knot]
        off = at - _predicted(np.arange(len(at)), knot, base, slope)
        if len(off) and np.abs(off).max() > 127:
            raise ValueError("a residual does not fit its byte")
        return points, knot, base, slope, off.astype(np.int8)

    def points(self) -> np.ndarray:
        """Code points of each text."""
        return np.diff(self.before[self.pieces])

    def locate(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Byte in the batch at which code point ``ranks[i]`` of text ``texts[i]`` begins: predicted, then corrected."""
        place = self.before[self.pieces[texts]] + ranks
        p = np.clip(np.searchsorted(self.before, place, "right") - 1, self.pieces[texts], self.pieces[texts + 1] - 1)
        at = self.first[p] + place - self.before[p]
        return _predicted(at, self.knot, self.base, self.slope) + self.residual[at]


def _predicted(ranks: np.ndarray, knot: np.ndarray, base: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Byte the segments give for boundaries."""
    s = np.searchsorted(knot, ranks, "right") - 1
    return base[s] + ((ranks - knot[s]) * slope[s] >> SCALE)


def _cut(data: np.ndarray, ends: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """End of every piece, and the number of pieces of each text. Pieces end before a code point begins."""
    sizes = np.diff(ends, prepend=0)
    if not len(sizes) or sizes.max() <= piece:
        return ends, np.ones(len(ends), np.int64)
    stops, each = [], np.ones(len(ends), np.int64)
    for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
        at = end - size
        while end - at > piece:
            cut = at + piece
            while cut > at + 1 and data[cut] & 0xC0 == 0x80:
                cut -= 1
            stops.append(cut)
            each[i] += 1
            at = cut
        stops.append(end)
    return np.array(stops, np.int64), each


def _slopes(at: np.ndarray, knot: int, stop: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest slope from ``knot`` that keep all boundaries up to each rank within the bound."""
    step = np.arange(1, stop - knot)
    rise = at[knot + 1 : stop] - at[knot]
    return np.maximum.accumulate((rise - bound) / step), np.minimum.accumulate((rise + bound) / step)


def _segments(at: np.ndarray, first: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of segments that begin on a boundary and miss none by more than ``bound``.

    All texts are tried with one segment each, side by side; those for which no slope holds are cut
    greedily, each segment as long as the cone of slopes stays open.
    """
    heads = first[:-1]
    sizes = np.diff(first)
    step = np.arange(len(at)) - np.repeat(heads, sizes)
    rise = at - np.repeat(at[heads], sizes)
    some = np.maximum(step, 1)
    low = np.maximum.reduceat(np.where(step > 0, (rise - bound) / some, -np.inf), heads) if len(heads) else np.zeros(0)
    high = np.minimum.reduceat(np.where(step > 0, (rise + bound) / some, np.inf), heads) if len(heads) else np.zeros(0)
    knots, slopes = [heads[low <= high]], [_middle(low, high)[low <= high]]
    for i in np.flatnonzero(low > high).tolist():
        knot, end, wide = int(first[i]), int(first[i + 1]), 4096
        while knot < end:
            stop = min(knot + wide, end)
            least, most = _slopes(at, knot, stop, bound)
            broken = np.flatnonzero(least > most)
            if not len(broken) and stop < end:
                wide *= 2
                continue
            last = int(broken[0]) if len(broken) else len(least)
            knots.append(np.array([knot]))
            slopes.append(_middle(least[last - 1 : last], most[last - 1 : last]) if last else np.zeros(1, np.int64))
            knot, wide = knot + 1 + last, max(4096, 2 * last)
    knots_, slopes_ = np.concatenate(knots).astype(np.int64), np.concatenate(slopes).astype(np.int64)
    order = np.argsort(knots_, kind="stable")
    return knots_[order], slopes_[order]


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The slope halfway, as a whole number; 0 for a text without code points."""
    slope = np.zeros(len(low))
    np.add(low, high, out=slope, where=np.isfinite(low) & np.isfinite(high))
    return (slope / 2 * (1 << SCALE)).round().astype(np.int64)


def transform(texts: list[bytes], plain: np.ndarray, spm: np.ndarray, one: np.ndarray, two: np.ndarray):
    """Form, code points, prefix and middle length (-1 where plain) and output of each UTF-8 text.

    ``one`` and ``two`` are numbers that give the cuts (modulo the code points plus one). ``plain`` asks
    for the text unchanged; an empty text or one that holds a mark is left unchanged too.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    index = RankIndex.fit(data, ends)
    points = index.points()
    asis = plain | (points == 0) | np.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], bool)
    cuts = np.sort(np.stack([one % (points + 1), two % (points + 1)]), axis=0)
    rows = np.arange(len(texts))
    begins = ends - [len(t) for t in texts]
    left, right = index.locate(rows, cuts[0]) - begins, index.locate(rows, cuts[1]) - begins
    out = []
    for text, same, turned, a, b in zip(texts, asis.tolist(), spm.tolist(), left.tolist(), right.tolist()):
        if same:
            out.append(text)
        elif turned:
            out.append(SUFFIX + text[b:] + PREFIX + text[:a] + MIDDLE + text[a:b])
        else:
            out.append(PREFIX + text[:a] + SUFFIX + text[b:] + MIDDLE + text[a:b])
    form = np.where(asis, PLAIN, np.where(spm, SPM, PSM)).tolist()
    return form, points, np.where(asis, -1, cuts[0]), np.where(asis, -1, cuts[1] - cuts[0]), out


def restore(output: bytes, form: str) -> bytes:
    """The text an output was made of. Texts with marks in them are never cut, so the first mark of a kind is the one put there."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    cut = output.index(second, len(first))
    head, rest = output[len(first) : cut], output[cut + len(second) :]
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == PSM else tail + middle + head


def numbers(key: Column, seed: str = "1:") -> Column:
    """Array of the first four 8-digit groups of sha256(seed followed by the key), as numbers; a null key is the empty text."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)))


def _batches(docs: DataFrame, key: str, text: str, seed: str, plain_from: int, spm_below: int, slice_bytes: int, schema: str, shape):
    asked = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"), numbers(F.col(key), seed).alias("h")
    )

    def cut(batches):
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1).to_pylist()
            h = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, 4)
            for a, b in by_size(bodies, slice_bytes):
                part = h[a:b]
                made = transform(bodies[a:b], part[:, 2] % 100 >= plain_from, part[:, 3] % 100 < spm_below, part[:, 0], part[:, 1])
                yield shape(ids.slice(a, b - a), bodies[a:b], made)

    return asked.mapInArrow(cut, schema)


def _lengths(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values < 0)


def fill_in_middle(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = "1:", plain_from: int = 90, spm_below: int = 20, slice_bytes: int = 2_000_000
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` (the rearranged text) of every row.

    The cuts, the form and whether a text stays plain follow from sha256 of ``seed`` and the id alone, so
    a run can be repeated on any cluster: plain for a share of ``100 - plain_from`` percent, for empty
    texts and for texts that hold a mark; of the others ``spm_below`` percent suffix first. A null text
    is the empty text; a null id is hashed like the empty text and stays null; repeated rows are cut alike;
    other columns are not read; an empty table gives no rows. Lengths are code points, null where plain.
    Texts are taken in slices of ``slice_bytes``; a longer one makes a slice of its own, fitted piece by piece.
    """

    def shape(ids, bodies, made):
        form, points, prefix, middle, out = made
        columns = [ids, pa.array(points, pa.int64()), pa.array(form, pa.string()), _lengths(prefix), _lengths(middle), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return _batches(docs, key, text, seed, plain_from, spm_below, slice_bytes, schema, shape)


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = "1:", plain_from: int = 90, spm_below: int = 20, slice_bytes: int = 2_000_000) -> DataFrame:
    """The rows of :func:`fill_in_middle` with ``output_sha256`` and ``restored_sha256`` in place of the output.

    The second is the digest of the text that :func:`restore` makes of output and form, so both texts are
    hashed where they are made and neither leaves its task.
    """

    def shape(ids, bodies, made):
        form, points, prefix, middle, out = made
        written = [hashlib.sha256(o).hexdigest() for o in out]
        again = [hashlib.sha256(restore(o, f)).hexdigest() for o, f in zip(out, form)]
        columns = [ids, pa.array(points, pa.int64()), pa.array(form, pa.string()), _lengths(prefix), _lengths(middle), pa.array(written, pa.string()), pa.array(again, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _batches(docs, key, text, seed, plain_from, spm_below, slice_bytes, schema, shape)
