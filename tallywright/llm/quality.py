"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The normal equations are sums over rows, so every task adds up its own and the engine adds the tasks up;
the driver solves a system of the number of features. Calibration pools adjacent violators over counts
of score bins, from rows that the regression did not see.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_size, ragged, stored, texts_of, word_hashes, words_of

NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "high_bytes", "newlines", "marks", "stops", "pipes", "shouts", "signs", "braces",
    "words_with_sign", "words_upper", "words_number", "distinct_words", "line_length", "repeated_lines", "entropy", "vowels", "marks_per_word", "longest_word",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` for each text; all zero for a text without words."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data, starts, ends, owner = words_of(texts)
    original = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    size = np.diff(begin) - 1
    some = np.maximum(size, 1)
    each = np.bincount(owner, minlength=n)
    words = np.maximum(each, 1)
    length = ends - starts

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[begin[1:] - 1] - total[begin[:-1]]) / some

    def has(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.bincount(owner, weights=total[ends] > total[starts], minlength=n) / words

    kind = np.zeros((256, 9), bool)
    for column, chars in enumerate((b".,;:", b"|", b"!?", b"#$%&*@^~=+<>", b"{}[]()_\\/", b"aeiou")):
        kind[list(chars), column] = True
    upper = (original >= 65) & (original <= 90)
    digit = (original >= 48) & (original <= 57)
    mark = ((original > 32) & (original < 48)) | ((original > 57) & (original < 65)) | ((original > 90) & (original < 97)) | ((original > 122) & (original < 127))
    letters = ((data >= 97) & (data <= 122)) | (data >= 128)
    out = np.zeros((n, len(NAMES)))
    mean = np.bincount(owner, weights=length, minlength=n) / words
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(each), mean
    out[:, 3] = np.sqrt(np.maximum(np.bincount(owner, weights=length.astype(float) ** 2, minlength=n) / words - mean**2, 0))
    out[:, 4], out[:, 5], out[:, 6], out[:, 7], out[:, 8] = share(upper), share(digit), share(original >= 128), share(original == 10), share(mark)
    for k in range(5):
        out[:, 9 + k] = share(kind[original, k])
    out[:, 14] = has(kind[original, 3])
    lower = np.concatenate([[0], np.cumsum((original >= 97) & (original <= 122), dtype=np.int64)])
    capital = np.concatenate([[0], np.cumsum(upper, dtype=np.int64)])
    out[:, 15] = np.bincount(owner, weights=(capital[ends] > capital[starts]) & (lower[ends] == lower[starts]), minlength=n) / words
    out[:, 16] = has(digit)
    hashes = word_hashes(data, starts, ends)
    out[:, 17] = _distinct(owner, hashes, n) / words
    line_begin = np.concatenate([[0], np.flatnonzero(original == 10) + 1, begin[1:-1]])
    line_begin = np.unique(line_begin)
    line_end = np.append(line_begin[1:] - 1, begin[-1] - 1)
    full = line_end > line_begin
    line_begin, line_end = line_begin[full], line_end[full]
    in_text = np.searchsorted(begin, line_begin, "right") - 1
    lines = np.maximum(np.bincount(in_text, minlength=n), 1)
    out[:, 18] = np.log1p(size / lines)
    out[:, 19] = 1 - _distinct(in_text, word_hashes(data, line_begin, line_end), n) / lines
    # entropy of the distribution of bytes
    cells = np.bincount(np.repeat(np.arange(n), size) * 256 + original[ragged(begin[:-1], size)], minlength=n * 256).reshape(n, 256) / some[:, None]
    out[:, 20] = -(cells * np.log2(np.where(cells > 0, cells, 1))).sum(1)
    out[:, 21] = share(kind[data, 5]) / np.maximum(share(letters), 1e-3)
    out[:, 22] = share(mark) * some / words
    if len(owner):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first], 23] = np.log1p(np.maximum.reduceat(length, first))
    out[each == 0] = 0
    return out


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def document_statistics(docs: DataFrame, slice_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, stats`` of every row."""

    def measure(batches):
        for batch in batches:
            texts = texts_of(batch)
            parts = [statistics(texts[a:b]) for a, b in by_size(texts, slice_chars)] or [np.zeros((0, len(NAMES)))]
            rows = np.concatenate(parts).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, stats array<float>")


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # calibration: scores, rising
    levels: np.ndarray  # and the share of label 1 at each

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def pool(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic fit of ``ones / counts``: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for n, y in zip(counts.tolist(), ones.tolist()):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, y2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + y2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for n, y, k in blocks]) if blocks else np.zeros(0)


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Element-wise sum of ``make(batch)``, a vector of ``width``, over all tasks. Only ``width`` numbers reach the driver."""

    def add(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    summed = rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in summed:
        out[r.i] = r.v
    return out


def fit(rows: DataFrame, *, waves: int = 256, ridge: float = 1e-3, bins: int = 400, seed: int = 8) -> Model | None:
    """Model from ``stats, label, calibrate``; rows marked ``calibrate`` only calibrate. None without rows to learn from."""
    d = len(NAMES)

    def moments(batch):
        s = _stats(batch)
        return np.concatenate([[len(s)], s.sum(0), (s**2).sum(0)])

    total = _sums(rows.where(~F.col("calibrate")), moments, 1 + 2 * d)
    if total[0] == 0:
        return None
    mean = total[1 : 1 + d] / total[0]
    spread = np.sqrt(np.maximum(total[1 + d :] / total[0] - mean**2, 1e-8))
    rng = np.random.default_rng(seed)
    # kernel width: about the distance of two usual rows
    model = Model(mean, spread, rng.normal(size=(d, waves)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, waves), np.zeros(0), np.zeros(0), np.zeros(0))
    width = waves + d + 1

    def equations(batch):
        z = model.features(_stats(batch))
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch.column("label").to_numpy()])

    sums = _sums(rows.where(~F.col("calibrate")), equations, width * width + width)
    left, right = sums[: width * width].reshape(width, width), sums[width * width :]
    model.weights = np.linalg.solve(left + ridge * total[0] * np.eye(width) / width, right)
    low, high = -0.5, 1.5

    def binned(batch):
        at = np.clip(((model.raw(_stats(batch)) - low) / (high - low) * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(at, minlength=bins), np.bincount(at, weights=batch.column("label").to_numpy(), minlength=bins)])

    held = _sums(rows.where("calibrate"), binned, 2 * bins)
    if held[:bins].sum() == 0:
        held = _sums(rows, binned, 2 * bins)
    full = np.flatnonzero(held[:bins])
    model.edges = low + (full + 0.5) * (high - low) / bins
    model.levels = pool(held[:bins][full], held[bins:][full])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held: Column, *, calibrate_share: int = 6, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``doc_id, text``.

    ``labels`` holds ``doc_id, quality``; repeated labels of a document are averaged, null ones are not
    read. Rows where ``held`` (an expression over ``doc_id``) is true are not learned from; one in
    ``calibrate_share`` of the others calibrates. A null text is empty and is scored like any other. A
    null ``doc_id`` stays null, repeated rows are scored each, other columns are not read; without labels
    every score is 0.5; an empty table gives no rows.
    """
    stats = stored(document_statistics(docs), "document-statistics")
    truth = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    rows = stats.where(~held).join(truth, "doc_id").select("stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(calibrate_share)) == 0).alias("calibrate"))
    model = fit(stored(rows, "labelled-statistics"))

    def score(batches):
        for batch in batches:
            values = model.score(_stats(batch)) if model is not None and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values), pa.array((values >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
