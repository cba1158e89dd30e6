"""Language identification by script ranges, word scores and a Viterbi path with a switching penalty.

A word's script leaves only the languages that are written in it. Each of those scores the word by its
character trigrams, and the best path through the words of a text, paying a penalty for every change of
language, labels spans. The language of a document is the one with most letters in its spans.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import let_go, sliced, summed_cells, texts_of

# First and last code point of script ranges.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "southeast": ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF)),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "ethiopic": ((0x1200, 0x139F),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}
OTHER = len(SCRIPTS)
UNDETERMINED = "und"
BUCKETS = 1 << 16

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Script number of each code point (255: no part of a word), its lower-case form, and whether it is a letter (not a mark)."""
    if not _TABLES:
        script = np.full(0x110000, OTHER, np.uint8)
        letter = np.zeros(0x110000, bool)
        for number, ranges in enumerate(SCRIPTS.values()):
            for first, last in ranges:
                script[first : last + 1] = number
        lower = np.arange(0x110000, dtype=np.int32)
        for p in range(0x110000):
            c = chr(p)
            kind = unicodedata.category(c)[0]
            letter[p] = kind == "L"
            if kind not in "LM":
                script[p] = 255
            elif len(low := c.lower()) == 1:
                lower[p] = ord(low)
        _TABLES.update(script=script, lower=lower, letter=letter)
    return _TABLES["script"], _TABLES["lower"], _TABLES["letter"]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # log likelihood of each trigram bucket, by language
    scripts: np.ndarray  # whether a language is written in a script


def _words(texts: list[str]):
    """Code points (lowered, a blank at each end of a word), and start, end, text, script and place of each word that has a letter."""
    script, lower, real = _tables()
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    kind = script[points]
    letter = kind != 255
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # marks without a letter are no word
    if len(starts):
        some = np.logical_or.reduceat(real[points], starts)
        starts, ends = starts[some], ends[some]
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    return np.where(letter, lower[points], 32), starts, ends, owner, kind[starts], starts - begin[owner]


def _trigrams(points: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each place."""
    p = points.astype(np.uint32)
    left, right = np.concatenate([[32], p[:-1]]).astype(np.uint32), np.concatenate([p[1:], [32]]).astype(np.uint32)
    h = (left * np.uint32(0x9E3779B1) ^ p) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13)) ^ right) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


WIDTH = BUCKETS + OTHER + 1


def _counted(texts: list[str]) -> np.ndarray:
    """Cells of one language that its texts add to: trigram buckets, then scripts by letters."""
    points, starts, ends, _, kinds, _ = _words(texts)
    return np.concatenate([_trigrams(points)[points != 32].astype(np.int64), BUCKETS + np.repeat(kinds.astype(np.int64), ends - starts)])


def model_of(languages: list[str], cells: np.ndarray, smoothing: float = 0.5, written: float = 0.01) -> Model:
    """Model from ``WIDTH`` counts of each language. ``written``: least share of a language's letters in a script it uses."""
    cells = np.asarray(cells, np.float64).reshape(len(languages), WIDTH)
    count, share = cells[:, :BUCKETS] + smoothing, cells[:, BUCKETS:]
    weights = np.log(count / count.sum(1, keepdims=True)).astype(np.float32).T
    return Model(languages, np.ascontiguousarray(weights), share >= written * np.maximum(share.sum(1, keepdims=True), 1))


def fit(rows: list[tuple[str, str]], smoothing: float = 0.5, written: float = 0.01) -> Model:
    """Model from (text, language) rows in memory."""
    languages = sorted({lang for _, lang in rows})
    cells = [np.bincount(_counted([t for t, x in rows if x == lang]), minlength=WIDTH) for lang in languages]
    return model_of(languages, np.array(cells), smoothing, written)


def _narrow(n: int) -> type:
    """Smallest signed integers that tell ``n`` languages apart."""
    return np.int8 if n <= 128 else np.int16 if n <= 1 << 15 else np.int32


def _viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts (``first``, ``size`` in words) step forward side by side, longest first."""
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[order], size[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(begin):
        return labels
    n = scores.shape[1]
    came = np.empty((len(scores), n), _narrow(n))
    best = scores[begin].copy()
    longer = len(size) - np.cumsum(np.bincount(size))
    own = np.arange(n, dtype=came.dtype)
    for k in range(1, int(size[0])):
        alive = int(longer[k])
        at = begin[:alive] + k
        now = best[:alive]
        top = now.argmax(1)
        reach = now[np.arange(alive), top][:, None] - penalty
        change = reach > now
        came[at] = np.where(change, top[:, None], own)
        best[:alive] = np.where(change, reach, now) + scores[at]
    state = best.argmax(1)
    last = begin + size - 1
    labels[last] = state
    # back from the ends; a text joins when its own last word is reached
    for k in range(int(size[0]) - 1, 0, -1):
        alive = int(longer[k])
        at = begin[:alive] + k
        state[:alive] = came[at, state[:alive]]
        labels[at - 1] = state[:alive]
    return labels


def label_words(texts: list[str], model: Model, penalty: float):
    """Start, end (code points in the text), text and language number (-1: none) of each word, and the scores of words that have none."""
    points, starts, ends, owner, kinds, place = _words(texts)
    if not len(starts) or not model.languages:
        return place, place + ends - starts, owner, np.full(len(starts), -1, np.int64), np.zeros((len(starts), len(model.languages)))
    gram = _trigrams(points)
    scores = np.empty((len(starts), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(model.weights[gram, k], dtype=np.float64)])
        scores[:, k] = total[ends] - total[starts]
    allowed = model.scripts[:, kinds].T
    none = ~allowed.any(1)
    strange = scores[none]
    scores[~allowed] = -1e6
    scores[none] = 0  # in a script that no language uses: it follows its neighbours but is nobody's
    size = np.bincount(owner, minlength=len(texts))
    labels = _viterbi(scores, np.cumsum(size) - size, size, penalty).astype(np.int64)
    labels[none] = -1
    return place, place + ends - starts, owner, labels, strange


def training_rows(docs: DataFrame, languages: dict[str, int], *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1000) -> DataFrame:
    """``l, t``: ``per_language`` documents of each language, whole, by hash of key and text.

    ``languages`` holds the rows of each language: with them the filter on the hash needs no join and runs
    where the rows are read, and about twice the sample is moved. Copies of one row have one hash; the rank
    cuts them before and after the shuffle, so no task gets more than the sample.
    """
    share = F.element_at(F.create_map(*(F.lit(x) for name, n in languages.items() for x in (name, min(1.0, 2.0 * per_language / n)))), F.col("l"))
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(key, text).alias("h"))
    near = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "t")))
    return ranked.where(F.col("n") <= per_language).select("l", "t")


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 1000) -> Model:
    """Model of the labelled rows of ``docs``: a bounded sample of ``per_language`` rows each, whole texts.

    Trigrams and letters are counted where the texts are; one number for each language, and ``WIDTH``
    counts a language, reach the driver. Rows with a null text or language are not learned from.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).cast("string").alias("l")).count()
    languages = {r["l"]: r["count"] for r in known.orderBy("l").collect()}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, OTHER + 1), bool))
    number = {name: k for k, name in enumerate(sorted(languages))}

    def count(batch):
        names = batch.column(0).to_pylist()
        texts = texts_of(batch, "t")
        cells = [number[names[i]] * WIDTH + _counted([t]) for i, t in enumerate(texts)]
        return np.concatenate(cells) if cells else np.zeros(0, np.int64)

    sample = training_rows(docs, languages, text=text, lang=lang, key=key, per_language=per_language)
    return model_of(list(number), summed_cells(sample.select("l", "t"), count, len(number) * WIDTH))


def _judged(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, int]]:
    """Language, score and number of spans of each text."""
    begin, end, owner, labels, strange = label_words(texts, model, penalty)
    n, known, count = max(len(model.languages), 1), labels >= 0, len(texts)
    letters = np.bincount(owner[known] * n + labels[known], weights=(end - begin)[known], minlength=count * n).reshape(count, n)
    every = np.bincount(owner, weights=end - begin, minlength=count)
    starts_span = np.ones(len(owner), bool)
    starts_span[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
    spans = np.bincount(owner[starts_span], minlength=count).tolist()
    best = letters.argmax(1)
    most = letters[np.arange(count), best]
    if model.languages:
        # letters, but in no script that a language uses: the best by trigrams alone, with score 0
        total = np.zeros((count, n))
        np.add.at(total, owner[~known], strange)
        best = np.where(most > 0, best, total.argmax(1))
        named = every > 0
    else:
        named = np.zeros(count, bool)
    return [(model.languages[k] if x else UNDETERMINED, m / e if x else 0.0, s) for x, k, m, e, s in zip(named.tolist(), best.tolist(), most.tolist(), every.tolist(), spans)]


def identify(docs: DataFrame, model: Model, *, penalty: float = 12.0, slice_chars: int = 1_000_000) -> DataFrame:
    """``doc_id, lang_pred, score, n_spans`` of every row of ``doc_id, text``.

    ``score`` is the share of the letters that stand in spans of ``lang_pred``; ties go to the language
    first by name. A text with letters of unknown scripts only gets the language whose trigrams fit best,
    with score 0. A null text, a text without letters (marks alone are none), and every text under a model
    without languages, is ``und`` with score 0. A null ``doc_id`` stays null, repeated rows are labelled
    each, other columns are not read, an empty table gives no rows.
    """
    schema = "doc_id long, lang_pred string, score double, n_spans int"

    def label(batches):
        let_go()
        for batch in batches:
            out = [row for part in sliced(batch, slice_chars) for row in _judged(texts_of(part), model, penalty)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int32())], names=["doc_id", "lang_pred", "score", "n_spans"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, schema)


def with_language(docs: DataFrame, model: Model, *, least: float = 0.5, penalty: float = 12.0, slice_chars: int = 1_000_000) -> DataFrame:
    """The documents of which at least ``least`` of the letters are in one language, ``lang`` set to it.

    A null text and a text without letters go. Repeated rows are judged each; all other columns stay as
    they are; documents without a column ``lang`` get one.
    """
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    schema = docs.schema

    def keep(batches):
        let_go()
        for batch in batches:
            at = batch.schema.get_field_index("lang")
            for part in sliced(batch, slice_chars):
                out = _judged(texts_of(part), model, penalty)
                named = part.set_column(at, part.schema.field(at), pa.array([o[0] for o in out], part.schema.field(at).type))
                yield named.filter(pa.array([o[0] != UNDETERMINED and o[1] >= least for o in out], pa.bool_()))

    return docs.mapInArrow(keep, schema)


def spans(docs: DataFrame, model: Model, *, penalty: float = 12.0) -> DataFrame:
    """``doc_id, start, stop, lang`` of every span of one language, in code points; between spans stand no letters."""

    def cut(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            begin, end, owner, labels, _ = label_words(texts, model, penalty)
            first = np.ones(len(owner), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (labels[1:] != labels[:-1])
            last = np.append(first[1:], True)[: len(first)]
            names = [*model.languages, UNDETERMINED]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in owner[first]], pa.int64()), pa.array(begin[first], pa.int64()), pa.array(end[last], pa.int64()), pa.array([names[k] for k in labels[first]], pa.string())],
                names=["doc_id", "start", "stop", "lang"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, start long, stop long, lang string")
