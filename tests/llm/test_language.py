from __future__ import annotations

import itertools

import numpy as np

from tallywright.llm import language as lg


def best_path(scores, penalty):
    n, k = scores.shape
    top = None
    for path in itertools.product(range(k), repeat=n):
        total = sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if top is None or total > top[0] + 1e-9:
            top = (total, path)
    return top[0]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 0, 5, 3, 6])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    first = np.cumsum(sizes) - sizes
    labels = lg._viterbi(scores, first, sizes, 0.8)
    for f, n in zip(first, sizes):
        if n:
            part, path = scores[f : f + n], labels[f : f + n]
            total = part[np.arange(n), path].sum() - 0.8 * (path[1:] != path[:-1]).sum()
            assert abs(total - best_path(part, 0.8)) < 1e-4


def test_held_out_accuracy_and_edges(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where("crc32(cast(doc_id as string)) % 5 != 0")
    model = lg.learn(train)
    assert model.languages == ["de", "en", "es", "fr"]
    held = docs.where("crc32(cast(doc_id as string)) % 5 = 0")
    got = {r.doc_id: r for r in lg.identify(held, model).collect()}
    rows = held.collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = [(1, None, "a"), (2, "", "a"), (3, "12 !! 🙂", "a"), (4, "привет мир", "a"), (None, "the of and", "a"), (4, "привет мир", "a")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, score string")
    out = lg.identify(frame, model).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id in (1, 2, 3)] == [("und", 0.0)] * 3
    # letters of a script that no language uses: a learned language all the same, with score 0
    strange = [(r.lang_pred, r.score) for r in out if r.doc_id == 4]
    assert len(set(strange)) == 1 and strange[0][0] in model.languages and strange[0][1] == 0
    assert [r.lang_pred for r in out if r.doc_id is None] == ["en"]
    assert lg.identify(frame.limit(0), model).collect() == []
    nothing = lg.fit([])
    assert {r.lang_pred for r in lg.identify(frame, nothing).collect()} == {"und"}


def test_mixed_text_gives_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lg.learn(docs)
    long = {r.lang: r.text for r in docs.where("n_chars > 3000").collect()}
    text = long["en"][:1500] + " " + long["de"][:1500]
    got = lg.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [r.lang for r in got] == ["en", "de"] and abs(got[1].start - 1500) < 30
    assert got[-1].stop <= len(text)


def plain_label(text, model, penalty=12.0):
    """The whole decision for one text, word by word and cell by cell."""
    script, lower, real = lg._tables()
    words, word = [], ""
    for c in text + " ":
        if script[ord(c)] != 255:
            word += c
        elif word:
            words.append(word)
            word = ""
    words = [w for w in words if any(real[ord(c)] for c in w)]
    if not words or not model.languages:
        return "und", 0.0
    n = len(model.languages)
    raw, rows, owned = [], [], []
    for w in words:
        low = np.array([32, *(lower[ord(c)] for c in w), 32])
        grams = lg._trigrams(low)[1:-1]
        score = [float(sum(np.float64(model.weights[g, k]) for g in grams)) for k in range(n)]
        may = model.scripts[:, script[ord(w[0])]]
        raw.append(score)
        owned.append(bool(may.any()))
        rows.append([s if m else -1e6 for s, m in zip(score, may)] if may.any() else [0.0] * n)
    best, back = rows[0], []
    for row in rows[1:]:
        step = [max(range(n), key=lambda j, k=k, best=best: best[j] - (penalty if j != k else 0)) for k in range(n)]
        best = [best[j] - (penalty if j != k else 0) + row[k] for k, j in enumerate(step)]
        back.append(step)
    at = max(range(n), key=lambda k: best[k])
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    path.reverse()
    letters = [0] * n
    for w, k, o in zip(words, path, owned):
        if o:
            letters[k] += len(w)
    top = max(range(n), key=lambda k: letters[k])
    if letters[top]:
        return model.languages[top], letters[top] / sum(map(len, words))
    return model.languages[max(range(n), key=lambda k: sum(r[k] for r in raw))], 0.0


def test_query_against_brute_force(spark, small):
    from tallywright.llm.catalog import held_out, op2_language_id

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = lg.learn(docs.where(~held_out(5, 0)))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = op2_language_id(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_label(texts[r.doc_id], model)
        assert (r.lang_pred, round(r.score, 9)) == (lang, round(score, 9)), r.doc_id


def test_learning_counts_whole_texts_of_a_bounded_sample(spark):
    # a long head in another script must not hide what follows, and copies without an id are not all learned from
    rows = [(i, "licence text " * 2000 + "щука жаба ёж " * 400, "ru") for i in range(6)] + [(100 + i, "the cat and the dog", "en") for i in range(50)]
    rows += [(None, "copy of the same", "en")] * 200 + [(None, None, "en"), (1, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = lg.learn(docs)
    assert model.languages == ["en", "ru"] and model.scripts[1, list(lg.SCRIPTS).index("cyrillic")]
    got = lg.identify(spark.createDataFrame([(1, "жаба и щука"), (2, "the dog and the cat"), (3, "\u0301\u0302")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["ru", "en", "und"]
    sample = lg.training_rows(docs, {"en": 250, "ru": 6}, per_language=20)
    # copies share a hash: all of them may fall outside, and never more than the sample inside
    assert 0 < sample.where("l = 'en'").count() <= 20 and sample.where("l = 'ru'").count() == 6
    assert {len(r.t) for r in sample.where("l = 'ru'").collect()} == {len(rows[0][1])}
    # learned by counts on tasks, or from the rows at hand: the same model
    plain = lg.fit([(t, x) for _, t, x in rows if t and x])
    assert np.array_equal(plain.weights, model.weights) and np.array_equal(plain.scripts, model.scripts)


def test_training_rows_are_filtered_below_the_exchange(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = lg.training_rows(docs, {"en": 10_000, "de": 10_000}, per_language=100)._jdf.queryExecution().executedPlan().toString()
    # a plan is read from its foot: the hash is tested before the only exchange
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert any("xxhash64" in line or "pmod(h" in line for line in plan.split("Exchange")[1].splitlines() if "Filter" in line)


def test_many_languages(spark):
    # one letter pair a language: 140 of them, more than a byte tells apart
    pairs = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyz"][:140]
    rows = [(i, " ".join([p * 3] * 20), f"l{i:03d}") for i, p in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lg.identify(docs, lg.learn(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: x for i, _, x in rows}


def test_stage_adds_a_language_column(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", 1.0), (2, None, 2.0), (3, "12", 3.0)], "doc_id long, text string, score double")
    model = lg.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    assert [tuple(r) for r in lg.with_language(docs, model).collect()] == [(1, "the cat and the dog", 1.0, "en")]
