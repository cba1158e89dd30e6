from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from tallywright.llm import frames
from tallywright.llm import jaccard_join as jj


def sets_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(texts):
    """doc_id: (size of set, component) by comparing everything that shares a shingle."""
    ids = list(texts)
    sets = {d: sets_of(texts[d]) for d in ids}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    seen = set()
    for group in where.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def check(frame, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.near_duplicates(frame).collect()}
    want = brute(texts)
    assert got == want
    return got


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for i in range(400):
        k = rng.integers(20, 300)
        part = base[:k].copy() if i % 3 else rng.integers(0, 2**63, k).astype(np.uint64)
        part[: rng.integers(0, 15)] = rng.integers(0, 2**63)
        sets.append(np.unique(part))
    sizes = np.array([len(s) for s in sets])
    vectors = [jj.count_vector(s) for s in sets]
    a, b, shared = jj.tree_pairs(sizes, vectors, np.zeros(len(sets), int))
    assert (7 * shared >= 3 * (sizes[a] + sizes[b])).all()
    kept = jj.forest(a, b, shared)
    assert len({frozenset(p) for p in zip(a[kept].tolist(), b[kept].tolist())}) == len(kept) < len(sets)
    got = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    for i in range(len(sets)):
        for j in range(i):
            if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (sizes[i] + sizes[j]):
                assert (j, i) in got
    side = (np.arange(len(sets)) >= 200).astype(int)
    a, b, _ = jj.tree_pairs(sizes, vectors, side)
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == {p for p in got if (p[0] < 200) != (p[1] < 200)}


def test_planted_groups(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    texts = {1: None, 2: "", 3: " \t\n", 4: "one two", 5: "ONE two", 6: "two one", 7: "a b c d e", 8: "A b c d e"}
    passage = [word() for _ in range(60)]
    for g in range(12):
        base = [word() for _ in range(rnd.choice([30, 80, 400]))]
        for _ in range(rnd.choice([2, 5, 40])):
            w = base[:]
            for _ in range(rnd.randint(0, len(w) // 40 + 2)):
                w[rnd.randrange(len(w))] = word()
            texts[100 + len(texts)] = " ".join(w)
    for _ in range(40):
        texts[100 + len(texts)] = " ".join(passage + [word() for _ in range(rnd.choice([5, 60, 300]))])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("class", __import__("pyspark").sql.functions.lit(1)).repartition(4)
    got = check(frame, texts)
    assert got[4][1] == got[5][1] == 4 and got[8][1] == 7 and got[6][1] == 6


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(docs, {r.doc_id: r.text for r in docs.collect()})


def test_blocks_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, "lonely words"), (9, "a b c d e f g x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jj.near_duplicates(frame, block=1).collect() if r.component_id is not None)
    assert got == [(0, 3, 5), (5, 3, 5), (5, 3, 5), (9, 4, 5)]
    assert jj.near_duplicates(frame.limit(0)).collect() == []


def test_row_without_id_bridges_two_documents(spark):
    words = [f"w{i}" for i in range(104)]
    low, mid, high = (" ".join(words[a : a + 80]) for a in (0, 10, 20))  # neighbours share 66 of 86 shingles, the outer two 56 of 96
    rows = [(3, low), (None, mid), (None, mid), (8, high), (11, "words of no other document at all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jj.near_duplicates(frame).collect())
    assert got == [(0, 76, 3), (0, 76, 3), (3, 76, 3), (8, 76, 3), (11, 3, 11)]
    assert [r.doc_id for r in jj.without_near_duplicates(frame.where("doc_id is not null")).orderBy("doc_id").collect()] == [3, 8, 11]
    assert sorted(r.doc_id or 0 for r in jj.without_near_duplicates(frame).collect()) == [0, 0, 3, 11]


def test_sort_within_sorts_each_stretch_for_itself():
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 6, 40)
    values = rng.integers(0, 1 << 63, int(sizes.sum()), dtype=np.uint64) << np.uint64(1)
    want = [x for a, n in zip(np.cumsum(sizes) - sizes, sizes) for x in sorted(values[a : a + n].tolist())]
    jj.sort_within(values, sizes)
    assert values.tolist() == want


class TaskSide:
    """In place of a frame: gives the function that tasks run on batches."""

    def __init__(self):
        self.sparkSession = self.sparkContext = self

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_tasks_hold_a_slice_of_a_batch_and_not_all_of_it(spark, monkeypatch):
    monkeypatch.setattr(frames, "_POWERS", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    rng = np.random.default_rng(7)
    text = ["".join(t) for t in rng.choice(list("abcdefghij    "), (4000, 3000))]
    ids = pa.array(range(len(text)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(text)], names=["doc_id", "row_key", "text"])
    for run in (jj.described(TaskSide()), jj.postings(TaskSide(), np.zeros(jj.CELLS, np.uint8))):
        tracemalloc.start()
        for part in run([batch]):
            assert part.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 48e6  # 22 MB; 103 MB when a task held all texts of its batch and powers for two million bytes


def test_word_hashes_are_the_same_in_any_strips(monkeypatch):
    texts = ["One two three", "", "x" * 500 + " two", " threeé ", "one"]
    data, starts, ends, _ = frames.words_of(texts)
    whole = frames.word_hashes(data, starts, ends)
    for strip in (1, 7, 64):
        monkeypatch.setattr(frames, "STRIP", strip)
        assert (frames.word_hashes(data, starts, ends) == whole).all()
    assert whole[1] == whole[4] and whole[0] == whole[6] and len(set(whole.tolist())) == 5


def test_slices_of_a_batch_are_the_ranges_of_its_texts():
    text = ["aaa", None, "", "ééé", "b" * 9, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(text, pa.string())], names=["doc_id", "text"])
    for limit in (1, 3, 5, 100):
        parts = [(p.column(0)[0].as_py(), p.column(0)[-1].as_py() + 1) for p in frames.sliced(batch, limit)]
        assert parts == list(frames.by_size(frames.texts_of(batch), limit))
    assert not list(frames.sliced(batch.slice(0, 0), 5))


def counting(monkeypatch):
    """The names of the tables stored from now on."""
    made, real = [], frames.stored
    for module in (frames, jj):
        monkeypatch.setattr(module, "stored", lambda frame, what: made.append(what) or real(frame, what))
    return made


def test_stars_are_the_least_nodes_reachable(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i + 1, i) for i in range(100, 120)] + [(7, 7), (5, None)]
    root = {n: n for link in links for n in link if n is not None}
    for _ in root:
        for a, b in links:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    found = [tuple(r) for r in frames.stars(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(found) == sorted((n, r) for n, r in root.items() if n != r)

    made = counting(monkeypatch)
    stars = [(1, 4), (5, 1), (2, 3), (3, 2), (1, 5)]
    assert sorted(tuple(r) for r in frames.stars(spark.createDataFrame(stars, "a long, b long")).collect()) == [(3, 2), (4, 1), (5, 1)]
    assert made == ["links"]
    assert frames.stars(spark.createDataFrame([], "a long, b long")).collect() == [] and made == ["links"] * 2


def test_a_table_is_stored_for_pairs_that_are_there_only(spark, monkeypatch):
    made = counting(monkeypatch)
    text = " ".join(f"word{i}" for i in range(40))
    texts = {4: text, 2: text + " more", 9: "some other words that stand alone here", 3: text + " and"}
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)
    assert len(made) <= 15  # 30 when rounds without a pair stored theirs, links were stored twice and stars searched anew
