from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallywright.llm import catalog, quality


def test_pooling_is_the_isotonic_fit():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 9, 40).astype(float)
    ones = np.floor(rng.random(40) * (counts + 1))
    level = quality.pool(counts, ones)
    rate = ones / counts
    # max-min formula of the isotonic fit
    for i in range(40):
        want = max(min(ones[a : b + 1].sum() / counts[a : b + 1].sum() for b in range(i, 40)) for a in range(i + 1))
        assert abs(level[i] - want) < 1e-9
    assert len(rate) == len(level)


def test_statistics_of_odd_texts():
    rows = quality.statistics(["", "   ", "a b a", "é\né\n", "X!! Y!!", "w" * 10_000])
    assert np.isfinite(rows).all() and (rows[:2] == 0).all()
    assert rows[2][quality.NAMES.index("distinct_words")] == 2 / 3
    assert rows[3][quality.NAMES.index("repeated_lines")] == 0.5
    assert rows[4][quality.NAMES.index("words_upper")] == 1.0
    one = quality.statistics(["a b a"])
    assert np.allclose(one[0], rows[2])


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = catalog.op8_quality_scores(spark, folder)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").toPandas()
    one, zero = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = (one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean()
    assert auc > 0.95
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, F.lit(False)).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert quality.quality_scores(docs.limit(0), labels, F.lit(False)).collect() == []
    labels = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, F.lit(False)).collect()
    assert all(0 <= r.score <= 1 for r in got)
