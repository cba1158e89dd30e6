from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from pyspark.sql import Row

from tallywright.llm import divergence
from tallywright.llm.catalog import ORACLES, QUERIES

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least=3, most=200):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        terms = TERM.findall((r.text or "").translate(UPPER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        v = len(kept)

        def chance(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: chance(count[lang, s]) for s in sources}
        q = chance(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {
                "pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s],
                "term": [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < most]
    return sorted(out)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def odd_rows(seed=2, n=150):
    rng = random.Random(seed)
    words = ["a", "A", "the", "The", "ÄÖ", "äö", "中文", "x1y", "don't", "é", "é", "Z", "rare", "😀", "İ", "naïve", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [
        Row(
            doc_id=i,
            text=" ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 40))),
            lang=rng.choice(["en", "en", "en", "de", None, ""]),
            # one source holds a third of the rows
            source=rng.choice(["hot", "hot", "hot", "a", "b", "ä", "Z", None, "p<q"]),
            term=1,
            n=None,
        )
        for i in range(n)
    ]
    rows += [rows[0]] * 5
    rows += [Row(doc_id=None, text=t, lang=lang, source=s, term=0, n=0) for t, lang, s in ((None, "en", "void"), ("", "en", "blank"), ("123 --", "en", "digits"), ("once only", "few", "x"), ("or twice", "few", "y"), ("alone", "lone", "s"), (None, None, None))]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, term int, n int"


def test_against_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain_audit(rows)
    assert rows_of(divergence.audit(docs)) == want
    # the same over many short ranges of the vocabulary, and with tasks that send their counts on at once
    assert rows_of(divergence.audit(docs, entries=3)) == want
    assert rows_of(divergence.audit(docs, most_terms=4)) == [r for r in want if r[2] == "pair" or r[5] <= 4]
    assert {(r[0], r[1]) for r in want if r[2] == "pair" and r[4] == 0} >= {("few", "x"), ("few", "y")}


def test_one_very_long_text_and_many_words(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300_000))
    rows = [Row(doc_id=i, text=long[i * 10 : 1_200_000 + i], lang="en", source=f"s{i % 3}", term=0, n=0) for i in range(6)]
    assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA), entries=100)) == plain_audit(rows)


def test_runs():
    rng = np.random.default_rng(0)
    for _ in range(50):
        entries, width = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        table = rng.integers(0, 3, (entries, width))
        at = np.argwhere(table)
        runs = divergence.run_columns(at[:, 0], at[:, 1], table[at[:, 0], at[:, 1]], entries, width)
        for k, (begin, value) in enumerate(runs):
            assert (np.repeat(value, np.diff(np.append(begin, entries))) == table[:, k]).all()
            assert (np.diff(value) != 0).all()


def test_chances_beyond_64_bits():
    counts = np.array([0, 10**12, 9 * 10**18 - 1])
    total = 9 * 10**18
    assert divergence.chances(counts, total, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 7) for c in counts]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_its_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    got = QUERIES["op13_source_audit"](spark, small)
    want = con.sql(ORACLES["op13_source_audit"])
    assert got.columns == want.columns
    assert rows_of(got) == sorted(want.fetchall())


def test_terms_of_bytes_are_those_of_the_text():
    rng = random.Random(3)
    odd = [rng.randint(0, 127), rng.randint(32, 122), 0x85, 0xA0, 0x2028, 0x1F600]
    texts = ["", *("".join(chr(rng.choice([*odd, rng.randint(65, 90), rng.randint(128, 0x2FF)])) for _ in range(rng.randint(0, 300))) for _ in range(60)), "", "x"]
    terms, owner = divergence.terms_of([t.encode() for t in texts])
    want = [(t, i) for i, text in enumerate(texts) for t in TERM.findall(text.translate(UPPER))]
    assert [(t.decode(), i) for t, i in zip(terms.to_pylist(), owner.tolist())] == want
    assert len(divergence.terms_of([b""])[0]) == 0 and divergence.counted([b""], [("", "")]).num_rows == 0


def test_counts_of_slices_add_up(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    n, d = Counter(), Counter()
    for r in rows:
        terms = TERM.findall((r.text or "").translate(UPPER))
        where = (r.lang or "", r.source or "")
        n.update((*where, t) for t in terms)
        d.update((*where, t) for t in set(terms))
    for size in (1, 50, 10**6):
        got = divergence.term_counts(docs, slice_bytes=size).collect()
        assert sorted((*r[:3], r.n, r.d) for r in got) == sorted((*k, c, d[k]) for k, c in n.items())


def test_counts_and_vectors_take_one_shuffle(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    plan = divergence.kept_vocabulary(divergence.term_counts(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
