from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from tallywright.llm import fill_middle
from tallywright.llm.catalog import ORACLES, QUERIES
from tallywright.llm.fill_middle import RankIndex, restore, transform

ALPHABET = "ab \nZäßñ中文字😀ﬁ́"


def odd_texts(seed: int, n: int, longest: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        run = rng.choice([1, 3, 400])  # long runs of one width make the slope change
        text = "".join(rng.choice(ALPHABET) * rng.randint(1, run) for _ in range(rng.randint(0, longest)))
        out.append(text)
    return out


@pytest.mark.parametrize("piece", [5, 300, fill_middle.PIECE])
@pytest.mark.parametrize("bound", [1, 7, fill_middle.BOUND])
def test_index_gives_every_boundary(bound, piece):
    texts = [t.encode() for t in ["", "a", "中", *odd_texts(bound, 30, 30), "", "x" * 9000 + "中" * 9000 + "ä" * 9000]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    index = RankIndex.fit(data, np.cumsum([len(t) for t in texts]), bound, piece)
    begin = 0
    for i, t in enumerate(texts):
        points = t.decode()
        assert index.points()[i] == len(points)
        offsets = [begin, *(begin + np.cumsum([len(c.encode()) for c in points])).tolist()]
        assert index.locate(np.full(len(offsets), i), np.arange(len(offsets))).tolist() == offsets
        begin += len(t)
    assert np.abs(index.residual.astype(int)).max() <= bound + 2


def test_segments_are_few_for_even_text():
    even = [("a" * 50_000).encode(), ("äö" * 30_000).encode(), ("x" * 5000 + "中" * 5000).encode()]
    index = RankIndex.fit(np.frombuffer(b"".join(even), np.uint8), np.cumsum([len(t) for t in even]))
    assert len(index.knot) <= 6
    assert index.residual.nbytes == sum(len(t.decode()) + 1 for t in even)


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_brute_force(spark):
    texts = odd_texts(3, 120, 60) + ["has <M> in it", "<P", "<", "S>", "<S<P<M", "<<", "a<P", "", None, "y" * 70_000 + "€" * 70_000]
    rows = [Row(doc_id=i * 7 - 50, text=t, output="clash", h=1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], Row(doc_id=None, text="no id here", output=None, h=None), Row(doc_id=None, text=None, output=None, h=None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h int").repartition(3)
    made = sorted(map(tuple, fill_middle.fill_in_middle(docs, slice_bytes=1000).collect()), key=repr)
    assert made == sorted(((r.doc_id, *by_hand(r.doc_id, r.text)) for r in rows), key=repr)
    assert {r[2] for r in made} == {"plain", "psm", "spm"}
    hashed = sorted(map(tuple, fill_middle.digests(docs).collect()), key=repr)
    assert hashed == sorted(((r.doc_id, *by_hand(r.doc_id, r.text)[:4], sha(by_hand(r.doc_id, r.text)[4]), sha(r.text or "")) for r in rows), key=repr)


def test_marks_that_arise_at_the_seams_do_no_harm():
    texts = [t.encode() for t in ("<<<<", "a<Pb>", "S>P>M>", "<P", "x<S")]
    for one in range(5):
        for two in range(5):
            for turned in (False, True):
                n = len(texts)
                form, _, _, _, out = transform(texts, np.zeros(n, bool), np.full(n, turned), np.full(n, one), np.full(n, two))
                assert [restore(o, f) for o, f in zip(out, form)] == texts


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digests(docs).collect() == [] and fill_middle.fill_in_middle(docs).collect() == []


def test_query_equals_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = QUERIES["op11_fill_middle"](spark, small)
    want = con.sql(ORACLES["op11_fill_middle"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
