"""Benchmark decontamination: passages query a BM25 index of the test items with block-max WAND.

Items are the indexed side, in blocks of items; for every term the index keeps its greatest impact in all
items and in each block. Impacts are divided by the score an item asks for, so the threshold is 1
everywhere. A passage whose terms' greatest impacts stay below 1 is skipped whole; else blocks are skipped
the same way; what is left is scored exactly and every item at or above 1 is retrieved. A retrieved item
counts as leaked if enough of its question and enough of its answer stand in the document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import mixed, ragged, sliced, texts_of, word_hashes

GRAM = 5
ANSWER = re.compile(r"(?:^|\n|\s)(?:answer|a)\s*:\s*", re.IGNORECASE)


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case runs of letters and digits, and the text each is in."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    solid = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    return word_hashes(data, starts, ends), np.searchsorted(begin, starts, "right") - 1


def grams(hashes: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hash of each run of ``n`` terms."""
    if len(hashes) < n or not n:
        return np.zeros(0, np.uint64)
    g = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        g = mixed(g + hashes[j : j + len(g)] * np.uint64(2 * j + 3))
    return g


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: at an answer mark, else the last sentence answers; one sentence is both."""
    marks = list(ANSWER.finditer(text))
    if marks and marks[-1].start() > 0:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    cuts = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip(" \n.!?"))]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, text)


@dataclass
class Index:
    ids: list[int]
    terms: np.ndarray  # sorted hashes
    first: np.ndarray  # postings of term t: first[t] to first[t + 1], by item
    item: np.ndarray
    impact: np.ndarray
    top: np.ndarray  # greatest impact of a term
    cell_first: np.ndarray  # postings of term t in block b: from cell_first[t * blocks + b]
    cell_top: np.ndarray  # greatest impact there
    blocks: int
    block: int
    parts: list[tuple[tuple[int, np.ndarray], ...]]  # of each item: gram size and grams of its question and answer


def build(items: list[tuple[int, str]], *, passage: int, share: float, block: int = 16, k1: float = 1.2, b: float = 0.75) -> Index:
    """Index of (id, text) items. ``share``: part of an item's own score that a passage has to reach."""
    items = sorted((i, t) for i, t in items if t is not None and i is not None)
    hashes, owner = terms_of([t for _, t in items])
    length = np.bincount(owner, minlength=len(items))
    # items of like length side by side keep block maxima low
    order = np.argsort(length, kind="stable")
    items = [items[i] for i in order if length[i]]
    hashes, owner = terms_of([t for _, t in items])
    n = len(items)
    length = np.bincount(owner, minlength=n)
    terms, which = np.unique(hashes, return_inverse=True)
    pair, tf = np.unique(which.astype(np.int64) * max(n, 1) + owner, return_counts=True)
    term, item = pair // max(n, 1), pair % max(n, 1)
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = k1 * (1 - b + b * length / max(length.mean() if n else 1, 1))
    impact = idf[term] * tf * (k1 + 1) / (tf + norm[item])
    own = np.bincount(item, weights=impact, minlength=n)
    # a passage of half-overlapping windows holds three quarters of its length of any longer item
    reach = share * own * np.minimum(1, 0.75 * passage / np.maximum(length, 1))
    impact = (impact / np.maximum(reach, 1e-12)[item]).astype(np.float64)
    blocks = -(-n // block) if n else 1
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    cells = term * blocks + item // block
    cell_first = np.searchsorted(cells, np.arange(len(terms) * blocks + 1))
    cell_top = np.zeros(len(terms) * blocks)
    np.maximum.at(cell_top, cells, impact)
    parts = []
    for _, text in items:
        halves = [terms_of([x])[0] for x in question_answer(text)]
        if not all(len(h) for h in halves):
            halves = [terms_of([text])[0]] * 2
        parts.append(tuple((min(GRAM, len(h)), np.unique(grams(h, min(GRAM, len(h))))) for h in halves))
    top = np.maximum.reduceat(impact, first[:-1]) if len(terms) else np.zeros(0)
    return Index([i for i, _ in items], terms, first, item, impact, top, cell_first, cell_top, blocks, block, parts)


def retrieve(index: Index, hashes: np.ndarray, owner: np.ndarray, half: int) -> dict[tuple[int, int], float]:
    """(text, item): best passage score, for all at or above 1. Passages are two halves of ``half`` terms."""
    found: dict[tuple[int, int], float] = {}
    if not len(hashes) or not len(index.terms):
        return found
    v = len(index.terms)
    at = np.minimum(np.searchsorted(index.terms, hashes), v - 1)
    known = index.terms[at] == hashes
    count = np.bincount(owner)
    place = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    per_text = count // half + 2
    base = np.cumsum(per_text) - per_text
    cell = (base[owner] + place // half + 1)[known]
    term = at[known]
    # each half is in two passages; a passage has each term once
    key = np.unique(np.concatenate([cell * v + term, (cell - 1) * v + term]))
    passage, term = key // v, key % v
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    if not len(starts):
        return found
    size = np.diff(np.append(starts, len(passage)))
    most = np.add.reduceat(index.top[term], starts)
    alive = most >= 1 - 1e-9
    if not alive.any():
        return found
    rows = ragged(starts[alive], size[alive])
    which = np.repeat(np.arange(int(alive.sum())), size[alive])
    names, term = passage[starts[alive]], term[rows]
    edges = np.flatnonzero(np.diff(which, prepend=-1))
    text_of = np.searchsorted(base, names, "right") - 1
    for blk in range(index.blocks):
        cells = term * index.blocks + blk
        most = np.add.reduceat(index.cell_top[cells], edges)
        open_rows = (most >= 1 - 1e-9)[which]
        if not open_rows.any():
            continue
        cells, who = cells[open_rows], which[open_rows]
        lo, hi = index.cell_first[cells], index.cell_first[cells + 1]
        posts = ragged(lo, hi - lo)
        who = np.repeat(who, hi - lo)
        pair, inverse = np.unique(who * len(index.ids) + index.item[posts], return_inverse=True)
        score = np.bincount(inverse, weights=index.impact[posts])
        for p, s in zip(pair[score >= 1 - 1e-9].tolist(), score[score >= 1 - 1e-9].tolist()):
            at_text = (int(text_of[p // len(index.ids)]), p % len(index.ids))
            found[at_text] = max(found.get(at_text, 0.0), s)
    return found


def leaked(index: Index, texts: list[str], half: int, least: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, share of the question, share of the answer) of all verified leaks."""
    hashes, owner = terms_of(texts)
    out = []
    held: dict[tuple[int, int], np.ndarray] = {}
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for (text, item), score in sorted(retrieve(index, hashes, owner, half).items()):
        own = hashes[bounds[text] : bounds[text + 1]]
        shares = []
        for n, wanted in index.parts[item]:
            if (text, n) not in held:
                held[text, n] = grams(own, n)
            shares.append(float(np.isin(wanted, held[text, n]).mean()))
        if min(shares) >= least:
            out.append((text, item, score, *shares))
    return out


def item_parts(items: DataFrame, part_bytes: int) -> list[list[tuple[int, str]]]:
    """The items in parts of about ``part_bytes``: an index is never larger, however many items there are."""
    known = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    if parts == 1:
        return [[(r.item_id, r.text) for r in known.collect()]]
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return [[(r.item_id, r.text) for r in known.where(part == k).select("item_id", "text").collect()] for k in range(parts)]


def find_leaks(docs: DataFrame, items: DataFrame, *, passage: int = 64, share: float = 0.5, least: float = 0.5, part_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap`` of every leaked item in every document.

    Passages are windows of ``passage`` terms, half overlapping, over the whole text. ``score`` is the best
    passage's part of what the item asks for (1 or more). Texts and items that are null or have no terms
    match nothing. A null ``doc_id`` stays null; repeated rows are reported each; other columns are not
    read; empty tables give no rows. Items beyond ``part_bytes`` are searched part by part.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for part in item_parts(items, part_bytes):
        index = build(part, passage=passage, share=share)

        def search(batches, index=index):
            for batch in batches:
                rows = []
                for each in sliced(batch, 2_000_000):
                    ids = each.column(0).to_pylist()
                    rows += [(ids[t], index.ids[i], s, q, w) for t, i, s, q, w in leaked(index, texts_of(each), passage // 2, least)]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, passage: int = 64, share: float = 0.5, least: float = 0.5, part_bytes: int = 16 << 20) -> DataFrame:
    """The documents in which no item leaked, with all their columns."""
    for part in item_parts(items, part_bytes):
        index = build(part, passage=passage, share=share)

        def keep(batches, index=index):
            for batch in batches:
                for each in sliced(batch, 2_000_000):
                    bad = np.zeros(each.num_rows, bool)
                    bad[[row[0] for row in leaked(index, texts_of(each), passage // 2, least)]] = True
                    yield each.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
