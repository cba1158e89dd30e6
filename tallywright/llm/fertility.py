"""Quality rules by tokeniser fertility: how public vocabularies cut a text tells whether it is prose of its language.

For each vocabulary a text has characters per token, the share of its tokens that are bytes of broken-up
characters, and the entropy of its tokens. Bands of these measures come from the whole corpus, one for each
language and class of length; a text outside its band is rejected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import at_spaces, by_size, mixed, stored, texts_of, word_hashes

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
# What a measure may stray at least, in units of the band's width, where a cell's quartiles lie together.
FLOORS = {"chars_per_token": 0.06, "byte_share": 0.01, "token_entropy": 0.2}
# Values are compared to three decimals, which bounds what a quartile has to count.
DIGITS = 3
# The characters of blank space, and the symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


# ---------------------------------------------------------------------- vocabularies
class Vocabulary:
    """A tokenizer file (``.model`` or ``.tiktoken``): token ids of texts, and which ids stand for bytes of broken-up characters."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda parts: library.encode(parts, num_threads=1)
            self.broken = np.array([library.is_byte(i) for i in range(library.get_piece_size())], bool)
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            library = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._ids = lambda parts: [library.encode_ordinary(p) for p in parts]
            self.broken = np.zeros(max(ranks.values()) + 1, bool)
            for token, rank in ranks.items():
                self.broken[rank] = not _whole(token)
        else:
            raise ValueError(f"no reader for the vocabulary {path}")

    def encode(self, texts: list[str], slice_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, text after text, and the number of each. A text beyond ``slice_chars`` is cut behind spaces."""
        parts = [at_spaces(t, slice_chars) for t in texts]
        found = [np.asarray(ids, np.int64) for ids in self._ids([p for own in parts for p in own])]
        sizes = np.array([len(f) for f in found], np.int64)
        counts = np.add.reduceat(sizes, np.cumsum([0, *(len(own) for own in parts)])[:-1]) if parts else np.zeros(0, np.int64)
        return np.concatenate([np.zeros(0, np.int64), *found]), counts


def _whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One reader for each file in a worker process."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def fertility(texts: list[str], words: Vocabulary, slice_chars: int = 2_000_000) -> np.ndarray:
    """Number of tokens and ``MEASURES`` of each text; zeros for a text without tokens."""
    ids, counts = words.encode(texts, slice_chars)
    n, some = len(texts), np.maximum(counts, 1)
    owner = np.repeat(np.arange(n), counts)
    broken = np.bincount(owner, weights=words.broken[ids], minlength=n)
    width = len(words.broken)
    cells, times = np.unique(owner * width + ids, return_counts=True)
    spent = np.bincount(cells // width, weights=times * np.log2(times), minlength=n)
    entropy = np.where(counts > 0, np.log2(some) - spent / some, 0)
    chars = np.array([len(t) for t in texts])
    return np.stack([counts, np.where(counts > 0, chars / some, 0), broken / some, entropy], axis=1)


# ---------------------------------------------------------------------- base counts
def base_counts(texts: list[str]) -> np.ndarray:
    """``BASE`` of each text. Words are told apart by 64-bit hashes, lines by their text."""
    n = len(texts)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(solid.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    owner = np.searchsorted(begin, starts, "right") - 1
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[np.append(begin[1:], len(data))] - total[begin]

    out = np.zeros((n, len(BASE)), np.int64)
    out[:, 0] = np.bincount(owner, minlength=n)
    out[:, 1] = per_text(solid & ((data & 0xC0) != 0x80))
    out[:, 2] = per_text(symbol[data])
    out[:, 3] = [_repeated_lines(t) for t in texts]
    out[:, 4] = _repeated_windows(word_hashes(data, starts, ends), owner, n)
    return out


def _repeated_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _repeated_windows(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Words in windows of three that stand twice or more in a text."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(owner[2:] == owner[:-2])
    window = mixed(mixed(mixed(hashes[inside]) + hashes[inside + 1]) + hashes[inside + 2])
    order = np.lexsort((window, owner[inside]))
    text, key = owner[inside][order], window[order]
    same = (text[1:] == text[:-1]) & (key[1:] == key[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = inside[order[twice]]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(owner[covered], minlength=n)


# ---------------------------------------------------------------------- on tables
def names(vocabularies: Sequence[str]) -> list[str]:
    """Columns of the measures: those of the first vocabulary plain, those of the others numbered."""
    return [m if k == 0 else f"{m}_{k + 1}" for k in range(len(vocabularies)) for m in MEASURES]


def measured(docs: DataFrame, vocabularies: Sequence[str], group: Column, *, key: str = "doc_id", text: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, cell_group, n_tokens``, ``BASE`` and the measures of every row; ``n_tokens`` is of the first vocabulary."""
    paths = list(vocabularies)
    columns = names(paths)

    def measure(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "body")
            for a, b in by_size(texts, slice_chars):
                base = base_counts(texts[a:b])
                each = [fertility(texts[a:b], vocabulary(p), slice_chars) for p in paths]
                made = [*batch.slice(a, b - a).columns[:2], pa.array(each[0][:, 0].astype(np.int64))]
                made += [pa.array(base[:, k]) for k in range(len(BASE))]
                made += [pa.array(e[:, 1 + k]) for e in each for k in range(len(MEASURES))]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "cell_group", "n_tokens", *BASE, *columns])

    schema = "doc_id long, cell_group string, n_tokens long, " + ", ".join([*(f"{c} long" for c in BASE), *(f"{c} double" for c in columns)])
    asked = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(group.cast("string"), F.lit("")).alias("cell_group"), F.col(text).alias("body"))
    return asked.mapInArrow(measure, schema)


def length_class(words: Column) -> Column:
    """Whole binary logarithm of the words: texts are held against texts less than twice as long, however they are cut into tokens."""
    return F.floor(F.log2(F.greatest(words, F.lit(1)))).cast("int")


def bands(rows: DataFrame, columns: Sequence[str], *, width: float, floors: dict[str, float] = FLOORS) -> DataFrame:
    """``cell_group, cell_class``, and ``low_``, ``high_`` of each measure.

    A band reaches ``width`` times the quartiles' distance (its floor at least) beyond both quartiles.
    Rows alike in every measure count once, so that copies of one text do not draw the quartiles together;
    a quartile counts values of three decimals, so its state is bounded however many rows a cell has.
    """
    alike = rows.select("cell_group", "cell_class", *columns).distinct()
    quartiles = alike.groupBy("cell_group", "cell_class").agg(*(F.percentile(F.round(c, DIGITS), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns))

    def beyond(c: str) -> Column:
        floor = floors[next(m for m in MEASURES if c.startswith(m))]
        return F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(floor)) * F.lit(width)

    return quartiles.select(
        "cell_group", "cell_class", *(x for c in columns for x in ((F.col(c)[0] - beyond(c)).alias(f"low_{c}"), (F.col(c)[1] + beyond(c)).alias(f"high_{c}")))
    )


def quality_rules(
    docs: DataFrame, vocabularies: Sequence[str], *, group: Column | None = None, key: str = "doc_id", text: str = "text", least_words: int = 50, most_repeated: int = 50, width: float = 3.0
) -> DataFrame:
    """``doc_id``, ``BASE``, ``base_failed``, ``kept`` and the measures of every row.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them in
    repeated windows of three. Of the other rows those are kept whose measures, in every vocabulary, lie in
    the band of their ``group`` (by default the column ``lang``) and class of length. Bands come from all rows
    that pass the base, so each row is held against the whole corpus, and a row alone in its cell is kept.

    A null text has no words and fails the base; a null group is a group of its own, the empty one; a null id
    stays null; repeated rows are judged alike; other columns are not read; an empty table gives no rows.
    """
    columns = names(vocabularies)
    rows = stored(measured(docs, vocabularies, F.col("lang") if group is None else group, key=key, text=text), "fertility")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "cell_class": length_class(F.col("n_words"))})
    # one row a cell, stored so that its size is known when the join is planned: small, it goes to the rows
    limits = stored(bands(rows.where("not base_failed"), columns, width=width), "bands")
    inside = [F.round(c, DIGITS).between(F.col(f"low_{c}"), F.col(f"high_{c}")) for c in columns]
    verdict = ~F.col("base_failed")
    for one in inside:
        verdict = verdict & F.coalesce(one, F.lit(False))
    judged = rows.join(limits, ["cell_group", "cell_class"], "left")
    return judged.select("doc_id", *BASE, "base_failed", verdict.alias("kept"), "cell_group", "n_tokens", *columns)
