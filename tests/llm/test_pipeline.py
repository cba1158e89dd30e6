from __future__ import annotations

import corpus_pipeline
from tallywright.llm import decontaminate, jaccard_join, secret_ledger


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    noise = spark.createDataFrame([(10_001, "123 456", "en", "x", 7), (10_002, None, "en", "x", None)], docs.schema)
    docs = docs.union(noise)
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert 10_001 not in kept[name] and 10_002 not in kept[name] and len(kept[name]) >= 195
            groups = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
        if name == "near_duplicates":
            assert set(kept[name]) == {d for d, c in groups.items() if d == c}
            bad = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
        if name == "decontamination":
            assert set(kept[name]) == set(kept["near_duplicates"]) - bad
        if name == "secrets":
            assert set(kept[name]) == set(kept["decontamination"])
            assert secret_ledger.secret_scan(docs).where("spans != ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == set(kept["secrets"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "best_fit_packing"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, cuts string, tail int, blob_key string, row_number int, __n int, score double, class string"


def test_odd_rows_and_clashing_columns(spark, small):
    word = " ".join(f"the cat number{i} sat on that mat" for i in range(40))
    rows = [
        (1, word, None, None, len(word), "a", 1, "b", 2, 3, 0.5, "c"),
        (1, word, None, None, len(word), "a", 1, "b", 2, 3, 0.5, "c"),  # the same row again
        (2, word + " and more", None, "x", 5, None, None, None, None, None, None, None),  # a near copy
        (None, "no id but password=hunter2secret in it and other words of the text", None, None, None, None, None, None, None, None, None, None),
        (3, "password: hunter2secret stands here with token=abcdef123456 beside it", None, None, 1, "q", 9, "r", 1, 1, 1.0, "s"),
        (4, None, None, None, None, None, None, None, None, None, None, None),
        (5, "", "en", None, 0, None, None, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, ODD)
    english = spark.createDataFrame([(i, f"the dog and the cat sat on that mat with text number {i}", "en") for i in range(1000, 1020)], "doc_id long, text string, lang string")
    docs = docs.unionByName(english, allowMissingColumns=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        assert docs.columns == columns
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.where("doc_id = 1").count() == 1 and 2 not in kept and 4 not in kept and 5 not in kept
    assert "hunter2secret" not in kept[3].text and "hunter2secret" not in kept[None].text
    assert (kept[3].cuts, kept[3].tail, kept[3].blob_key, kept[3].row_number, kept[3].lang) == ("q", 9, "r", 1, "en")
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert packed.count() == docs.count()


def test_empty_table_passes_every_stage(spark, small):
    docs = spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        assert docs.collect() == [] and len(docs.columns) == 12
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).collect() == []
