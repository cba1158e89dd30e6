"""Removal of repeated passages with an enhanced suffix array, spread over the cluster by minimizers.

Every window of ``LENGTH`` bytes is owned by its anchor, the position of the least hash of ``SEED`` bytes
in it, so equal windows have equal anchors at equal places. An anchor carries the text its windows cover.
Anchors with the same seed meet in one shard, where the suffixes from the anchors on are sorted, their
common prefixes give the interval tree by a stack scan, and the texts before the anchors, sorted
backwards, tell how diverse the left extensions inside an interval are. An interval of depth r together
with a left extension of ``LENGTH - r`` bytes or more is a repeat; its occurrences are all in the group,
and the least document among them decides which others go.

1. Blocks of documents send short fingerprints of their seeds; seeds met once in the whole corpus drop out.
2. They send the texts of the other anchors, each distinct one once with its least document.
3. Shards return, for the windows of each text, the least document of all; blocks remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import mixed, ragged, shards_for, text_bytes

LENGTH, SEED = 50, 16
SPAN = LENGTH - SEED + 1  # seeds in a window
WIDTH = LENGTH + SPAN - 1  # bytes that the windows of one anchor can cover
LEFT = SPAN - 1
LAST = 2**63 - 1  # place of rows without an id: behind all others


# ---------------------------------------------------------------------- enhanced suffix array
def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Depth, depth of the parent, first and last suffix of each interval of depth ``least`` or more.

    ``lcp[i]`` is the common prefix of sorted suffixes i - 1 and i. One scan with a stack of open intervals.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = [(least - 1, 0)]  # depth, first
    values = lcp.tolist()
    for i in range(1, len(values) + 1):
        depth = max(values[i], least - 1) if i < len(values) else least - 1
        first = i - 1
        while stack[-1][0] > depth:
            r, first = stack.pop()
            out.append((r, max(stack[-1][0], depth), first, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row of bytes with the row before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 16):
        b = min(len(rows), a + (1 << 16))
        differ = rows[a:b] != rows[a - 1 : b - 1]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, start), ...]) of every maximal repeat of ``least`` bytes or more, with all occurrences.

    For texts of one task: sorted suffixes, the interval tree, and of its intervals those whose left
    extensions differ.
    """
    suffixes = sorted((t[i:], k, i) for k, t in enumerate(texts) for i in range(len(t)))
    lcp = np.zeros(len(suffixes), np.int64)
    for n in range(1, len(suffixes)):
        a, b = suffixes[n - 1][0], suffixes[n][0]
        stop = min(len(a), len(b))
        lcp[n] = next((i for i in range(stop) if a[i] != b[i]), stop)
    out = []
    for depth, _, first, last in zip(*lcp_intervals(lcp, least)):
        places = [(k, i) for _, k, i in suffixes[first : last + 1]]
        lefts = {texts[k][i - 1] if i else (k, "start") for k, i in places}
        if len(lefts) > 1:
            out.append((int(depth), sorted(places)))
    return sorted(out)


def least_owners(contexts: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, offset, least owner) of the windows that have an owner less than that of their context.

    A context is ``WIDTH`` bytes around an anchor at ``LEFT``; it has the windows that start ``low`` to
    ``high`` bytes before the anchor.
    """
    right, left = contexts[:, LEFT:], contexts[:, LEFT - 1 :: -1]
    by_right, by_left = _row_order(right), _row_order(left)
    depth, parent, first, last = lcp_intervals(common_prefixes(right[by_right]), SEED)
    left_common = common_prefixes(left[by_left])
    found = ([], [], [])
    # an interval serves the offsets whose right part it covers and its parent doesn't
    from_offset, to_offset = LENGTH - depth, LENGTH - parent - 1
    for offset in range(SPAN):
        serving = np.flatnonzero((from_offset <= offset) & (offset <= to_offset))
        if not len(serving):
            continue
        size = last[serving] - first[serving] + 1
        rows = by_right[ragged(first[serving], size)]
        group = np.repeat(serving, size)
        mine = (low[rows] <= offset) & (offset <= high[rows])
        rows, group = rows[mine], group[mine]
        if len(rows) < 2:
            continue
        # left extensions of this many bytes: intervals of the backward order
        side = np.empty(len(contexts), np.int64)
        side[by_left] = np.cumsum(left_common < offset)
        order = np.lexsort((owner[rows], side[rows], group))
        rows, group = rows[order], group[order]
        lefts = side[rows]
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (lefts[1:] != lefts[:-1])
        least = owner[rows[new]][np.cumsum(new) - 1]
        less = least < owner[rows]
        for column, values in zip(found, (rows[less], np.full(int(less.sum()), offset), least[less])):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)


def _row_order(rows: np.ndarray) -> np.ndarray:
    pad = -rows.shape[1] % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8")
    return np.lexsort(words.T[::-1])


# ---------------------------------------------------------------------- anchors of a block
class Anchors:
    """Anchors of some pieces of text: position, first and last window start, seed hash, and the piece each is in."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces) + bytes(WIDTH), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        n = int(edges[-1])
        word = self.data[: n + 64].astype(np.uint64)
        for step in (1, 2, 4):  # eight bytes from each place on
            word[:-step] = (word[:-step] << np.uint64(8 * step)) | word[step:]
        seed = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        seed ^= seed >> np.uint64(32)
        seed *= np.uint64(0xBF58476D1CE4E5B9)
        # least hash in each window with its place in the low bits: the leftmost of equal ones
        least = (seed >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
        reach = 1
        while reach * 2 <= SPAN:
            if n > reach:
                least[: n - reach] = np.minimum(least[: n - reach], least[reach:])
            reach *= 2
        if n > SPAN - reach:
            least[: n - (SPAN - reach)] = np.minimum(least[: n - (SPAN - reach)], least[SPAN - reach :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(edges)
        inside = ragged(edges[:-1], np.maximum(size - LENGTH + 1, 0))  # window starts
        at = place[inside]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        begin = np.flatnonzero(new)
        self.position = at[begin]
        self.first = inside[begin]
        self.last = inside[np.append(begin[1:], len(at)) - 1] if len(begin) else begin
        self.seed = mixed(seed[self.position])
        self.piece = np.searchsorted(edges, self.position, "right") - 1
        self.edges = edges

    def contexts(self, rows: np.ndarray) -> np.ndarray:
        """Text of the windows of some anchors, other bytes 0xFF, and the offsets of the last and first window."""
        at = self.position[rows][:, None] - LEFT + np.arange(WIDTH)
        inside = (at >= self.first[rows][:, None]) & (at < self.last[rows][:, None] + LENGTH)
        out = np.full((len(rows), WIDTH + 2), 0xFF, np.uint8)
        out[:, :WIDTH][inside] = self.data[at[inside]]
        out[:, WIDTH] = self.position[rows] - self.last[rows]
        out[:, WIDTH + 1] = self.position[rows] - self.first[rows]
        return out


def _pieces(texts: list[bytes], limit: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in batches of about ``limit`` bytes; long ones in pieces that overlap by a window less one byte."""
    batch, of, start, held = [], [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            piece = text[at : at + limit + LENGTH - 1]
            batch.append(piece)
            of.append(k)
            start.append(at)
            held += len(piece)
            if held >= limit:
                yield batch, np.array(of), np.array(start)
                batch, of, start, held = [], [], [], 0
            at += limit
            if at + LENGTH > len(text):
                break
    if batch:
        yield batch, np.array(of), np.array(start)


def _fingerprints(seed: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed % np.uint64(shards)).astype(np.int64), (seed // np.uint64(shards) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _block(table: pa.Table, limit: int):
    """Ids and texts of a block in a fixed order, and its anchors, batch by batch."""
    ids = [LAST if i is None else i for i in table.column("doc_id").to_pylist()]
    texts = [(t or "").encode("utf-8", "replace") for t in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    ids, texts = np.array([ids[k] for k in order], np.int64), [texts[k] for k in order]
    return ids, texts, [(Anchors(batch), of, start) for batch, of, start in _pieces(texts, limit)]


MESSAGE = "block int, shard int, seeds binary, rows binary, owners binary"


def _message(block, shard, seeds=None, rows=None, owners=None) -> tuple:
    return block, shard, seeds, rows, owners


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "shard", "seeds", "rows", "owners"])


def _seeds(table: pa.Table, shards: int, limit: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    _, _, batches = _block(table, limit)
    seed = np.concatenate([a.seed for a, _, _ in batches] or [np.zeros(0, np.uint64)])
    shard, print_ = _fingerprints(seed, shards)
    out = []
    order = np.lexsort((print_, shard))
    shard, print_ = shard[order], print_[order]
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        values, count = np.unique(print_[bounds[s] : bounds[s + 1]], return_counts=True)
        # a seed met twice here counts as met elsewhere
        out.append(_message(block, s, values.tobytes(), np.packbits(count > 1).tobytes()))
    return _messages(out)


def _repeated(table: pa.Table) -> pa.Table:
    """For each block, which of its fingerprints are met more than once."""
    seeds = [np.frombuffer(s, np.uint32) for s in table.column("seeds").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(r, np.uint8), count=len(s)).astype(bool) for r, s in zip(table.column("rows").to_pylist(), seeds)]
    every = np.concatenate(seeds)
    values, which, count = np.unique(every, return_inverse=True, return_counts=True)
    many = count > 1
    np.logical_or.at(many, which, np.concatenate(twice))
    out, at = [], 0
    for block, shard, own in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), seeds):
        hit = own[many[which[at : at + len(own)]]]
        at += len(own)
        if len(hit):
            out.append(_message(block, shard, hit.tobytes()))
    return _messages(out)


def _kept(table: pa.Table, flags: pa.Table, shards: int, limit: int):
    """Ids, texts and, for each batch, the anchors with repeated seeds; with the distinct contexts of each shard."""
    ids, texts, batches = _block(table, limit)
    repeated = {s: np.frombuffer(v, np.uint32) for s, v in zip(flags.column("shard").to_pylist(), flags.column("seeds").to_pylist()) if v is not None}
    keys = np.sort(np.concatenate([np.zeros(0, np.int64), *((np.int64(s) << 32) + v.astype(np.int64) for s, v in repeated.items())]))
    found = []
    for anchors, of, start in batches:
        shard, print_ = _fingerprints(anchors.seed, shards)
        key = (shard << 32) + print_.astype(np.int64)
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        rows = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
        piece = anchors.piece[rows]
        doc = of[piece]
        # places in the document
        first = anchors.first[rows] - anchors.edges[piece] + start[piece]
        position = anchors.position[rows] - anchors.edges[piece] + start[piece]
        last = first + anchors.last[rows] - anchors.first[rows]
        found.append((shard[rows], anchors.contexts(rows), doc, position, first, last))
    shard, context, doc, position, first, last = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros((0, WIDTH + 2), np.uint8), *[np.zeros(0, np.int64)] * 4)
    # distinct contexts by shard, each with its least document in the block
    view = np.ascontiguousarray(context).view(f"V{WIDTH + 2}").ravel()
    _, lead, which = np.unique(view, return_index=True, return_inverse=True) if len(view) else (view, np.zeros(0, np.intp), np.zeros(0, np.intp))
    least = np.full(len(lead), LAST, np.int64)
    if len(view):
        np.minimum.at(least, which, ids[doc])
    return ids, texts, (shard[lead], context[lead], least), (which, doc, position, first, last)


def _send(key, table: pa.Table, flags: pa.Table, shards: int, limit: int) -> pa.Table:
    if not table.num_rows or not flags.num_rows:
        return _messages([])
    block = table.column("block")[0].as_py()
    _, _, (shard, context, least), _ = _kept(table, flags, shards, limit)
    out = []
    for s in np.unique(shard).tolist():
        rows = np.flatnonzero(shard == s)
        out.append(_message(block, s, None, context[rows].tobytes(), least[rows].tobytes()))
    return _messages(out)


def _decide(table: pa.Table) -> pa.Table:
    """In a shard: for each block's contexts, runs of offsets with a lesser owner elsewhere."""
    blocks, shards = table.column("block").to_pylist(), table.column("shard").to_pylist()
    parts = [np.frombuffer(r, np.uint8).reshape(-1, WIDTH + 2) for r in table.column("rows").to_pylist()]
    owner = np.concatenate([np.frombuffer(o, np.int64) for o in table.column("owners").to_pylist()])
    every = np.concatenate(parts)
    view = np.ascontiguousarray(every).view(f"V{WIDTH + 2}").ravel()
    _, lead, which = np.unique(view, return_index=True, return_inverse=True)
    least = np.full(len(lead), LAST, np.int64)
    np.minimum.at(least, which, owner)
    rows, offset, source = least_owners(every[lead][:, :WIDTH], every[lead][:, WIDTH].astype(np.int64), every[lead][:, WIDTH + 1].astype(np.int64), least)
    # least owner of every window of every distinct context
    best = np.repeat(least[:, None], SPAN, axis=1)
    best[rows, offset] = source
    out, at = [], 0
    for block, shard, part in zip(blocks, shards, parts):
        mine = best[which[at : at + len(part)]]
        less = mine < owner[at : at + len(part)][:, None]
        at += len(part)
        row, col = np.nonzero(less)
        if not len(row):
            continue
        value = mine[row, col]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (value[1:] != value[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(row)) - 1
        runs = np.stack([row[begin], col[begin], col[end]], axis=1).astype(np.int32)
        out.append(_message(block, shard, None, runs.tobytes(), value[begin].tobytes()))
    return _messages(out)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def _remove(key, table: pa.Table, notes: pa.Table, shards: int, limit: int) -> pa.Table:
    """Rows of RESULT for a block, from its flags (with seeds) and answers (with rows)."""
    if not table.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.string()), pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    asked = pa.compute.is_valid(notes.column("seeds"))
    ids, texts, (shard, _, least), (which, doc, position, first, last) = _kept(table, notes.filter(asked), shards, limit)
    best = np.repeat(least[:, None], SPAN, axis=1)
    answers = notes.filter(pa.compute.invert(asked))
    for s, runs, owners in zip(answers.column("shard").to_pylist(), answers.column("rows").to_pylist(), answers.column("owners").to_pylist()):
        local = np.flatnonzero(shard == s)
        runs, owners = np.frombuffer(runs, np.int32).reshape(-1, 3).astype(np.int64), np.frombuffer(owners, np.int64)
        size = runs[:, 2] - runs[:, 1] + 1
        best[np.repeat(local[runs[:, 0]], size), ragged(runs[:, 1], size)] = np.repeat(owners, size)
    gone = best[which] < ids[doc][:, None] if len(which) else np.zeros((0, SPAN), bool)
    row, offset = np.nonzero(gone)
    start = position[row] - offset
    good = (first[row] <= start) & (start <= last[row])  # windows that the anchor owns
    row, start = row[good], start[good]
    order = np.lexsort((start, doc[row]))
    row, start = row[order], start[order]
    bounds = np.searchsorted(doc[row], np.arange(len(texts) + 1))
    columns: list[list] = [[], [], [], [], [], []]
    for k, text in enumerate(texts):
        begin = start[bounds[k] : bounds[k + 1]]
        spans = []
        if len(begin):
            cut = np.flatnonzero(np.append(True, begin[1:] > begin[:-1] + LENGTH))
            spans = list(zip(begin[cut].tolist(), (begin[np.append(cut[1:], len(begin)) - 1] + LENGTH).tolist()))
        kept, at = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        values = (None if ids[k] == LAST else int(ids[k]), len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": b} for a, b in spans])
        for column, value in zip(columns, values):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame, *, block_bytes: int = 5 << 20, batch_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row of ``doc_id, text``.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller
    ``doc_id``; strings never cross documents and are judged on the input. ``spans`` are the maximal
    removed runs in bytes. A null text is empty. Rows of one ``doc_id`` don't remove each other; rows
    without one come behind all others. Other columns are not read; an empty table gives no rows.
    """
    shards = shards_for(text_bytes(docs), block_bytes)
    key = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(shards)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("block"))
    seeds = texts.groupBy("block").applyInArrow(lambda t: _seeds(t, shards, batch_bytes), MESSAGE)
    flags = seeds.groupBy("shard").applyInArrow(_repeated, MESSAGE)
    sent = texts.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(lambda k, t, f: _send(k, t, f, shards, batch_bytes), MESSAGE)
    answers = sent.groupBy("shard").applyInArrow(_decide, MESSAGE)
    notes = flags.union(answers)
    return texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(lambda k, t, n: _remove(k, t, n, shards, batch_bytes), RESULT)
