from __future__ import annotations

import math
import mmap
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.llm import catalog
from tallywright.llm import lm_trie as lm


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [7], [0, 0, 5], rng.integers(0, 2**63, 1000), rng.integers(0, 500, 3000), [2**64 - 1]):
        values = np.sort(np.array(values, np.uint64))
        ef = lm.EliasFano(lm.EliasFano.pack(values))
        assert (ef.values() == values).all()
        if len(values) > 20:
            assert (ef.values(7, 19) == values[7:19]).all()


def kneser(counts):
    """Discounts and the probabilities of a dict {context: {word: count}}, written out plainly."""
    seen = Counter(c for ws in counts.values() for c in ws.values())
    y = seen[1] / (seen[1] + 2 * seen[2])
    d = {k: min(max(k - (k + 1) * y * (sum(v for c, v in seen.items() if c >= 5) if k + 1 == 5 else seen[k + 1]) / seen[k], 0.05 * k), 0.95 * k) if seen[k] else 0.75 for k in (1, 2, 3)}
    out = {}
    for h, ws in counts.items():
        total = sum(ws.values())
        out[h] = ({w: (c - d[min(c, 3)]) / total for w, c in ws.items()}, sum(d[min(c, 3)] for c in ws.values()) / total)
    return out


def test_trie_answers_and_maps_from_a_file(tmp_path):
    rng = np.random.default_rng(1)
    context, word = rng.integers(0, 2**63, 40).astype(np.uint64), rng.integers(0, 2**32, 60).astype(np.uint32)
    counts = defaultdict(dict)
    for _ in range(700):
        h, w = int(context[min(int(rng.exponential(8)), 39)]), int(word[rng.integers(60)])
        counts[h][w] = counts[h].get(w, 0) + 1
    rows = sorted((h, w, c) for h, ws in counts.items() for w, c in ws.items())
    buffer = lm.Trie.build(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.uint32), np.array([r[2] for r in rows]))
    path = tmp_path / "trie"
    path.write_bytes(buffer)
    with path.open("rb") as file:
        trie = lm.Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
        want = kneser(counts)
        asked = [(int(h), int(w)) for h in [*context, np.uint64(5), np.uint64(2**64 - 1)] for w in [*word, 0, 2**32 - 1]]
        code, weight = trie.query(np.array([a for a, _ in asked], np.uint64), np.array([b for _, b in asked], np.uint32))
    for (h, w), p, b in zip(asked, lm.probability(code), lm.probability(weight)):
        own, left = want.get(h, ({}, 0))
        assert p == pytest.approx(own.get(w, 0), rel=1e-3) and p <= own.get(w, 0) + 1e-12
        assert b == pytest.approx(left, rel=1e-3)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows):
    """Base sums and scores of (id, text, held) rows, with one shard's discounts."""
    train = Counter(w for _, t, held in rows if not held for w in [*tokens(t), None])
    n, v = sum(train.values()), len(train)
    pairs = defaultdict(Counter)
    for _, t, held in rows:
        if not held:
            w = [*tokens(t), None]
            for a, b in zip(["", *w], w):
                pairs[a][b] += 1
    ones = Counter(train.values())
    d = min(max(ones[1] / (ones[1] + 2 * ones[2]), 0.05), 0.95)
    model, out = kneser(pairs), {}
    for i, t, _ in rows:
        w = [*tokens(t), None]
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["", *w], w):
            own, left = model.get(a, ({}, 1.0))
            score += math.log10(own.get(b, 0) + left * ((train[b] - d) / n if train[b] else d * v / n))
        out[i] = (len(w), sum(train[x] > 0 for x in w), n, base, score)
    return out


def test_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("block", F.lit(1))
    held = catalog.held_out(7, 2)
    rows = [(r.doc_id, r.text, r.h) for r in docs.withColumn("h", held).collect()]
    want = brute(rows)
    many = {r.doc_id: r for r in lm.score_documents(docs.repartition(3), held, block_chars=20_000).collect()}
    one = {r.doc_id: r for r in lm.score_documents(docs.repartition(3), held, block_chars=50_000, shard_bytes=1 << 40).collect()}
    assert set(many) == set(want)
    for i, (size, known, n, base, score) in want.items():
        for r in (many[i], one[i]):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, n)
            assert r.base_score == pytest.approx(base)
            # shards estimate discounts of their own; quantised codes lie a little below
            assert r.score == pytest.approx(score, rel=0.03)
        assert many[i].held_out == next(h for j, _, h in rows if j == i)
    better = [r.score > r.base_score for r in many.values() if r.held_out]
    assert sum(better) > 0.9 * len(better)


def test_edges(spark):
    rows = [(1, None, "q"), (1, None, "q"), (None, "a B a", "q"), (2, "b " * 3000, "q"), (3, "new words", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held string")
    got = lm.score_documents(frame, F.col("doc_id") == 3).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(0, False, 4, 4, 3007), (1, False, 1, 1, 3007), (1, False, 1, 1, 3007), (2, False, 3001, 3001, 3007), (3, True, 3, 1, 3007)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    none = lm.score_documents(frame, F.lit(True)).collect()
    assert len(none) == 5 and {(r.train_tokens, r.score, r.n_known) for r in none} == {(0, 0.0, 0)}
    assert lm.score_documents(frame.limit(0), F.lit(False)).collect() == []


def test_frequent_context_is_dealt_to_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"a w{int(20_000 * x**2)}" for x in rng.random(100)), i % 10 == 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    want = brute(rows)
    for r in lm.score_documents(frame, F.col("held"), block_chars=20_000, slice_tokens=4_000).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.score == pytest.approx(want[r.doc_id][4], rel=0.03)
    # half of all tokens have one context; its bigrams must not meet in one shard
    blocks = lm._blocks(frame, 8, 20_000).cache()
    counts = blocks.where("kind = 'words'").groupBy("shard").applyInArrow(lambda t: lm._count_words(t, 8, 4_000), lm.MESSAGE)
    known = blocks.where("kind = 'tokens'").union(counts.where("kind = 'counts'"))
    asked = known.groupBy("block").applyInArrow(lambda t: lm._ask(t, 8, 270, 1), lm.MESSAGE)
    sizes = [r.n for r in asked.groupBy("shard").agg(F.sum("tokens").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
