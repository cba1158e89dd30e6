from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import Row

from tallywright.llm import fertility
from tallywright.llm.catalog import QUERIES, VOCABULARIES, table

PATHS = [public_tokenizers.path(v) for v in VOCABULARIES]
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit)


ODD = ["", " ", "a", "a a a", "a a a a", "x y z x y z", "x y z\nx y z", "\n\n\na\na\n a\na\r\n", "ä ö ü ß", "#*$%&|<>", "a\x0bb\x0cc\x1cd", "中文 中文 中文 中文", "\x00 \x00 \x00 \x00", "Aa aa Aa aa Aa"]


def test_base_counts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b", " ", "\n", "ä", "|"]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    assert [tuple(r) for r in fertility.base_counts(texts).tolist()] == [plain_base(t) for t in texts]
    assert fertility.base_counts([]).shape == (0, 5)


def plain_fertility(text, ids, broken):
    if not ids:
        return 0, 0, 0, 0
    times = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in times.values())
    return len(ids), len(text) / len(ids), sum(broken(i) for i in ids) / len(ids), entropy


def test_measures():
    texts = [*ODD, "The quick brown fox.", "Größe ist größer als groß.", "😀 ✂ 🜁 plain", "word " * 400]
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATHS[1], "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    back = {v: k for k, v in ranks.items()}

    def torn(i):
        return back[i].decode("utf-8", "replace").encode() != back[i]

    for path, ids, broken in ((PATHS[0], pieces.encode, pieces.is_byte), (PATHS[1], other.encode_ordinary, torn)):
        got = fertility.fertility(texts, fertility.vocabulary(path))
        np.testing.assert_allclose(got, [plain_fertility(t, ids(t), broken) for t in texts], atol=1e-9)
    assert fertility.fertility(texts, fertility.vocabulary(PATHS[0]))[texts.index("😀 ✂ 🜁 plain"), 2] > 0.2
    assert fertility.fertility([], fertility.vocabulary(PATHS[0])).shape == (0, 4)
    with pytest.raises(ValueError):
        fertility.Vocabulary("words.txt")


def plain_verdicts(rows, columns, width):
    """The same rules in plain Python, over the measures."""
    cells = defaultdict(set)
    for r in rows:
        if not r.base_failed:
            cells[r.cell_group, int(math.log2(r.n_words))].add(tuple(r[c] for c in columns))
    out = []
    for r in rows:
        kept = not r.base_failed
        for k, c in enumerate(columns):
            if not kept:
                break
            held = [round(v[k], 3) for v in cells[r.cell_group, int(math.log2(r.n_words))]]
            low, high = np.percentile(held, [25, 75])
            floor = next(f for m, f in fertility.FLOORS.items() if c.startswith(m))
            reach = width * max(high - low, floor)
            kept = low - reach - 1e-9 <= round(r[c], 3) <= high + reach + 1e-9
        out.append(kept)
    return out


def test_query_against_brute_force(spark, small):
    rows = QUERIES["op12_fertility_rules"](spark, small).collect()
    docs = {r.doc_id: r for r in table(spark, small, "documents").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    assert [r.kept for r in rows] == plain_verdicts(rows, fertility.names(PATHS), 3.0)
    assert any(not r.kept and not r.base_failed for r in rows)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice(["the", "er", "ing", "on", "an", "st", "re", "a", "th"]) for _ in range(random.Random(i).randint(1, 3))) for i in range(300)]


def test_rules_on_planted_rows(spark):
    rng = random.Random(5)
    good = [Row(doc_id=i, text=prose(rng, rng.randint(130, 180)), lang="en", kept="clash", low_byte_share=1.0) for i in range(60)]
    # a third of all rows are copies of one text
    copies = [Row(doc_id=100 + i, text=good[0].text, lang="en", kept=None, low_byte_share=None) for i in range(30)]
    runs = Row(doc_id=900, text=" ".join(f"same{i % 7}" + "x" * (i % 3) for i in range(150)), lang="en", kept="", low_byte_share=0.0)
    noise = Row(doc_id=901, text=" ".join("".join(chr(rng.randint(0x2800, 0x28FF)) for _ in range(3)) for _ in range(150)), lang="en", kept="", low_byte_share=0.0)
    short = Row(doc_id=902, text="too short", lang=None, kept="", low_byte_share=0.0)
    empty = Row(doc_id=903, text="", lang="en", kept="", low_byte_share=0.0)
    void = Row(doc_id=None, text=None, lang=None, kept="", low_byte_share=0.0)
    alone = Row(doc_id=904, text=noise.text, lang="xx", kept="", low_byte_share=0.0)
    long = Row(doc_id=905, text=" ".join("%x" % rng.getrandbits(24) for _ in range(200_000)), lang="en", kept="", low_byte_share=0.0)
    again = Row(doc_id=None, text=good[1].text, lang="en", kept="", low_byte_share=0.0)
    docs = spark.createDataFrame([*good, *copies, runs, noise, short, empty, void, alone, long, again, again], "doc_id long, text string, lang string, kept string, low_byte_share double")
    made = fertility.quality_rules(docs.repartition(5), PATHS).collect()
    assert len(made) == docs.count()
    kept = {r.doc_id: r.kept for r in made if r.doc_id is not None}
    assert all(kept[r.doc_id] for r in good + copies)
    assert not kept[901] and not kept[902] and not kept[903]
    assert kept[904] and kept[905]
    assert sorted((r.n_words, r.kept) for r in made if r.doc_id is None) == sorted([(0, False)] + [(len(again.text.split()), True)] * 2)


def test_empty_table(spark):
    assert fertility.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string"), PATHS).collect() == []
