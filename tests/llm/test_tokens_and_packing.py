from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallywright.llm import packing, token_count
from tallywright.llm.transducer import Transducer, word_starts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "don't we'll 'tis ''s !'s I'RE they'rex 'r 'r' 'v1 it's's", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ñandũ ﬁ Ǆ ß ẞ K", "１２３ ٣٤ ½ ² 中文 日本 🙂🙂 é̀",
    " x y​z\x00\x01", "a" * 600, "1234567890!!??..,,--", "'", "'l", "'ll'", "<|endoftext|", "\x85a\x1cb﻿c", "한국어 नमस्ते ไทย", None,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_machine_gives_the_ids_of_the_library(library):
    rnd = random.Random(1)
    near = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(32, 127), rnd.randrange(0xA0, 0x600), 39, 115, rnd.randrange(0x2000, 0x3100), rnd.randrange(0x1F300, 0x1F700), rnd.randrange(0x20)]))
    texts = [t or "" for t in ODD] + ["".join(near() for _ in range(80)) for _ in range(150)]
    for machine in (Transducer(PATH), Transducer(PATH, max_states=50)):  # the second starts its tables afresh each time
        for _ in range(2):
            counts, ids = machine.encode(texts, True)
            at = 0
            for text, n in zip(texts, counts.tolist()):
                assert ids[at : at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
                at += n
        assert (machine.encode(texts)[0] == counts).all()


def test_chunks_compose():
    rng = np.random.default_rng(3)
    classes = np.append(rng.integers(0, 13, 4000), 0).astype(np.uint8)
    whole = word_starts(classes, chunk=5000)
    for chunk in (1, 2, 7, 256):
        assert (word_starts(classes, chunk) == whole).all()


def test_counts_of_a_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = token_count.token_counts(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(library.encode(texts[r.doc_id], add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)
    odd = spark.createDataFrame([(None, t, 1) for t in ODD], "doc_id long, text string, n_tokens int")
    got = [r.n_tokens for r in token_count.token_counts(odd, PATH, slice_chars=40).collect()]
    assert got == [len(library.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    assert token_count.token_counts(odd.limit(0), PATH).collect() == []


def held(packed):
    total = Counter()
    for pattern, times in packed:
        for length in pattern:
            total[length] += times
    return total


def fewest(pieces, capacity):
    """Least number of bins, by trying everything."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted(set(rooms)):
            if room >= pieces[i]:
                at = rooms.index(room)
                place(i + 1, [*rooms[:at], room - pieces[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rnd = random.Random(9)
    for _ in range(150):
        pieces = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        fixed, rest = packing.reduce_dominated(dict(Counter(pieces)), 20)
        assert held(fixed) + Counter(rest) == Counter(pieces) and all(sum(p) <= 20 for p, _ in fixed)
        left = sorted(Counter(rest).elements(), reverse=True)
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(pieces, 20)


def test_packed_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x"), (-3, "same words"), (-3, "same words"), (-4, "word " * 9000)], "doc_id long, text string")
    frame = docs.select("doc_id", "text").union(odd).repartition(5)
    rows = packing.pack_documents(frame, PATH).collect()
    want = Counter()
    for d in frame.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[a : a + 4096], "<u4")
            want[d.doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1
    assert packing.pack_documents(frame.limit(0), PATH).collect() == []


def test_patterns_grow_with_lengths_not_pieces():
    rng = np.random.default_rng(3)
    rows = []
    for n in (20_000, 80_000):
        length, count = np.unique(rng.integers(1400, 2001, n), return_counts=True)
        counts = dict(zip(length.tolist(), count.tolist()))
        packed = packing.patterns(counts, 4096)
        back = {}
        for pattern, times in packed:
            assert sum(pattern) <= 4096
            for k in pattern:
                back[k] = back.get(k, 0) + times
        assert back == counts
        rows.append(len(packed))
    assert max(rows) <= 2 * 601
