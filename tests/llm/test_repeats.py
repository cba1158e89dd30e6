from __future__ import annotations

import hashlib
import random

import numpy as np

from tallywright.llm import repeats as rp


def brute(texts):
    data = {d: (t or "").encode() for d, t in texts.items()}
    least: dict[bytes, int] = {}
    for d in sorted(data):
        for i in range(len(data[d]) - 49):
            least.setdefault(data[d][i : i + 50], d)
    out = {}
    for d, t in data.items():
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def check(frame, texts, **options):
    rows = rp.repeated_passages(frame, **options).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    assert got == brute(texts)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in rows)


def test_interval_tree_and_maximal_repeats():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(30)).encode() for _ in range(3)]
    got = dict()
    for length, places in rp.maximal_repeats(texts, 4):
        k, i = places[0]
        got[texts[k][i : i + length]] = places
    want = {}
    for text in texts:
        for n in range(4, 31):
            for i in range(31 - n):
                s = text[i : i + n]
                places = [(k, j) for k, t in enumerate(texts) for j in range(len(t) - n + 1) if t[j : j + n] == s]
                lefts = {texts[k][j - 1] if j else (k, "s") for k, j in places}
                rights = {texts[k][j + n] if j + n < len(texts[k]) else (k, "e") for k, j in places}
                if len(places) > 1 and len(lefts) > 1 and len(rights) > 1:
                    want[s] = places
    assert got == want


def test_planted_passages(spark):
    rnd = random.Random(7)
    letters = "abcdefghij éß🙂\n"
    pick = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [pick(n) for n in (49, 50, 51, 60, 200, 1000)] + ["x" * 300, "ab" * 100, " " * 80]
    texts = {1: None, 2: "", 3: "short"}
    for k in range(60):
        parts = [pick(rnd.choice([0, 3, 40, 300]))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 3)
            parts += [p[a : len(p) - rnd.randint(0, 3)], pick(rnd.choice([0, 1, 30]))]
        texts[rnd.randrange(10, 10**6)] = "".join(parts)
    copy = texts[max(texts)]
    texts[5] = texts[2_000_000] = copy
    frame = spark.createDataFrame([(d, t, "z") for d, t in texts.items()], "doc_id long, text string, block string").repartition(3)
    check(frame, texts)
    check(frame, texts, block_bytes=500, batch_bytes=130)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs, {r.doc_id: r.text for r in docs.collect()}, block_bytes=40_000)


def test_repeats_nulls_and_empty_table(spark):
    p = "0123456789" * 6
    frame = spark.createDataFrame([(4, p), (4, p), (None, p + "!"), (None, None), (9, p)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in rp.repeated_passages(frame).collect())
    assert got == [(4, 60, 0), (4, 60, 0), (9, 60, 60), (99, 0, 0), (99, 61, 60)]
    assert rp.repeated_passages(frame.limit(0)).collect() == []
