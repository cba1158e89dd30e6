from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import decontaminate as dc


def terms(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())


def brute_scores(items, text, passage, share, k1=1.2, b=0.75):
    docs = {i: Counter(terms(t)) for i, t in items if t and terms(t)}
    size = {i: sum(c.values()) for i, c in docs.items()}
    mean = sum(size.values()) / len(size)
    df = Counter(w for c in docs.values() for w in c)
    idf = {w: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    impact = lambda w, i: idf[w] * docs[i][w] * (k1 + 1) / (docs[i][w] + k1 * (1 - b + b * size[i] / mean))
    words, half, out = terms(text), passage // 2, {}
    for start in range(-half, len(words), half):
        have = set(words[max(start, 0) : start + passage])
        for i, c in docs.items():
            asked = share * sum(impact(w, i) for w in c) * min(1, 0.75 * passage / size[i])
            score = sum(impact(w, i) for w in c if w in have) / asked
            if score >= 1 - 1e-9:
                out[i] = max(out.get(i, 0), score)
    return out


def test_retrieval_is_exhaustive():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    pick = lambda n: " ".join(rnd.choices(vocabulary, weights=[1 / (i + 1) for i in range(120)], k=n))
    items = [(i, pick(rnd.choice([3, 12, 30, 90]))) for i in range(70)] + [(70, None), (71, "...")]
    texts = [pick(rnd.choice([0, 5, 40, 300])) + " " + rnd.choice(items[:70])[1] + " " + pick(20) for _ in range(25)]
    index = dc.build(items, passage=16, share=0.5, block=4)
    hashes, owner = dc.terms_of(texts)
    got = {(t, index.ids[i]): s for (t, i), s in dc.retrieve(index, hashes, owner, 8).items()}
    want = {(t, i): s for t, text in enumerate(texts) for i, s in brute_scores(items, text, 16, 0.5).items()}
    assert set(got) == set(want) and len(want) > 50
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_question_and_answer():
    assert dc.question_answer("Who? It was me.") == ("Who? ", "It was me.")
    assert dc.question_answer("Question: two and two\nAnswer: four") == ("Question: two and two", "four")
    assert dc.question_answer("one sentence only.") == ("one sentence only.",) * 2


def test_whole_table_finds_all_planted_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, items).collect()}
    grams = lambda text: {tuple(w[i : i + 5]) for w in [terms(text)] for i in range(len(w) - 4)}
    of = {r.item_id: grams(r.text) for r in items.collect()}
    full, none = set(), set()
    for d in docs.collect():
        have = grams(d.text)
        for i, want in of.items():
            share = len(want & have) / len(want)
            if share > 0.85:
                full.add((d.doc_id, i))
            elif share < 0.3:
                none.add((d.doc_id, i))
    assert full and full <= got and not got & none
    kept = {r.doc_id for r in dc.without_leaks(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in got}
    parts = {(r.doc_id, r.item_id) for r in dc.find_leaks(docs.where("doc_id < 300"), items, part_bytes=2000).collect()}
    assert {p for p in full if p[0] < 300} <= parts


def test_edges(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps. over the lazy dog today"), (2, None), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 1.0), (None, "THE quick brown fox jumps. Over the lazy dog, today!", 1.0), (2, "the dog " * 500, 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    got = dc.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.question_overlap, r.answer_overlap) for r in got] == [(None, 1, 1.0, 1.0)]
    assert dc.without_leaks(docs, items).count() == 3 and dc.without_leaks(docs, items).columns == docs.columns
    assert dc.find_leaks(docs.limit(0), items).collect() == [] and dc.find_leaks(docs, items.limit(0)).collect() == []
    assert np.isclose(len(dc.terms_of(["é É"])[0]), 2)
