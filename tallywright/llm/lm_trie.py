"""Language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with absolute discounting (three discounts, estimated as in modified
Kneser-Ney), interpolated with discounted unigrams by their raw counts, not continuation counts; words
never seen share the mass that the discounts leave. The corpus is read once into blocks of token
numbers. Shards of the vocabulary count words; shards of contexts count bigrams, build a trie each and
answer the blocks' questions from it. Blocks send each distinct word and bigram once, with its count, so
a frequent one costs no more than a rare one.

A trie has two levels, each a flat buffer that can be mapped from a file: contexts with monotone
pointers into the level below, and successors. The successors of a context are numbers relative to it,
made monotone over the whole level by adding up the contexts before; both are in Elias-Fano form, and a
successor is found by a search for the next value inside the range of its context. Opening a trie decodes
its levels into plain arrays, and the search is on those. Probabilities are
quantised logarithms of 16 bits, rounded down, so they never add up to more than one.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import _packed, _unpacked, mixed, ragged, shards_for, stored, text_bytes, texts_of, word_hashes, words_of

BEGIN = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
LEVELS, FLOOR = 65535, -10.0  # codes of log10 probabilities from FLOOR to 0; code 0 is none


# ---------------------------------------------------------------------- trie
class EliasFano:
    """A rising sequence: low bits packed, high bits in unary. Reads any buffer, a mapped file included."""

    def __init__(self, buffer):
        self.n, self.low_bits, self.high_bytes = struct.unpack_from("<qqq", buffer)
        low_bytes = -(-self.n * self.low_bits // 8)
        self.size = 24 + self.high_bytes + low_bytes
        self.high = np.frombuffer(buffer, np.uint8, self.high_bytes, 24)
        self.low = np.frombuffer(buffer, np.uint8, low_bytes, 24 + self.high_bytes)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, bool)
        bits[place] = True
        high = np.packbits(bits)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(bool).ravel()) if low_bits else np.zeros(0, np.uint8)
        return struct.pack("<qqq", n, low_bits, len(high)) + high.tobytes() + low.tobytes()

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Entries ``start`` to ``stop``."""
        stop = self.n if stop is None else stop
        ones = np.flatnonzero(np.unpackbits(self.high))[start:stop]
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits or stop <= start:
            return high
        first = start * self.low_bits // 8
        bits = np.unpackbits(self.low[first : -(-stop * self.low_bits // 8)])[start * self.low_bits - first * 8 :][: (stop - start) * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high + bits.reshape(-1, self.low_bits).astype(np.uint64) @ weights


class Trie:
    """Contexts, pointers, successors and quantised probabilities in one buffer."""

    def __init__(self, buffer):
        view, at, self.levels = memoryview(buffer), 0, []
        for _ in range(3):
            level = EliasFano(view[at:])
            self.levels.append(level)
            at += level.size
        n, m = self.levels[0].n, self.levels[2].n
        self.backoff = np.frombuffer(view, np.uint16, n, at)
        self.codes = np.frombuffer(view, np.uint16, m, at + 2 * n)
        contexts, pointers, successors = self.levels
        self.contexts = contexts.values()
        self.pointers = np.append(pointers.values(), m).astype(np.int64)
        self.successors = successors.values()
        # successors count on from the last of the context before
        self.base = np.where(self.pointers[:-1] > 0, self.successors[np.maximum(self.pointers[:-1] - 1, 0)] if m else 0, 0).astype(np.uint64)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, count: np.ndarray, sliced: tuple | None = None) -> bytes:
        """From distinct (context, word) sorted by both, and their counts of one or more. ``word`` has 32 bits.

        ``sliced``: contexts of which only a slice of the successors is here, and their totals over all slices.
        """
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        node = np.cumsum(new) - 1
        total = np.bincount(node, weights=count, minlength=len(first))
        if sliced is not None and len(sliced[0]):
            at = np.minimum(np.searchsorted(context[first], sliced[0]), len(first) - 1)
            here = context[first][at] == sliced[0]
            total[at[here]] = sliced[1][here]
        seen = np.bincount(np.minimum(count, 5), minlength=6).astype(float)
        discounts = np.zeros(4)
        y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + seen[2] else 0.5
        for k in (1, 2, 3):
            discounts[k] = min(max(k - (k + 1) * y * seen[k + 1] / seen[k], 0.05 * k), 0.95 * k) if seen[k] else 0.75
        taken = discounts[np.minimum(count, 3)]
        left = np.bincount(node, weights=taken, minlength=len(first)) / total
        # a context's numbers start behind those of the contexts before; 1 more, so that no two are equal
        last = np.append(first[1:], len(context)) - 1
        width = word[last].astype(np.uint64) + np.uint64(1)
        base = np.concatenate([np.zeros(1, np.uint64), np.cumsum(width)])[:-1]
        value = base[node] + word.astype(np.uint64) + np.uint64(1)
        parts = [EliasFano.pack(context[first]), EliasFano.pack(first), EliasFano.pack(value)]
        return b"".join(parts) + quantised(left).tobytes() + quantised((count - taken) / total[node]).tobytes()

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of the bigram's own probability (0: not seen) and of the weight of unigrams in its context (0: context not seen)."""
        if not len(self.contexts):
            return np.zeros(len(context), np.uint16), np.zeros(len(context), np.uint16)
        node = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[node] == context
        wanted = self.base[node] + word.astype(np.uint64) + np.uint64(1)
        # next value at or above the wanted one; it must lie in the range of the context
        at = np.searchsorted(self.successors, wanted)
        inside = known & (at < self.pointers[node + 1])
        at = np.minimum(at, len(self.successors) - 1)
        hit = inside & (self.successors[at] == wanted)
        return np.where(hit, self.codes[at], 0).astype(np.uint16), np.where(known, self.backoff[node], 0).astype(np.uint16)

    def weights(self, context: np.ndarray) -> np.ndarray:
        """Code of the weight of unigrams in each context (0: context not seen)."""
        if not len(self.contexts):
            return np.zeros(len(context), np.uint16)
        node = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return np.where(self.contexts[node] == context, self.backoff[node], 0).astype(np.uint16)


def quantised(p: np.ndarray) -> np.ndarray:
    code = np.floor((np.log10(np.maximum(p, 1e-300)) / -FLOOR + 1) * (LEVELS - 1)) + 1
    return np.where(p > 0, np.clip(code, 1, LEVELS), 0).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** (((code.astype(float) - 1) / (LEVELS - 1) - 1) * -FLOOR), 0.0)


# ---------------------------------------------------------------------- blocks and shards
MESSAGE = "block long, shard int, kind string, a binary, b binary, c binary, n1 long, n2 long, types long, tokens long"


def _rows(rows: list[tuple]) -> dict:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return {"arrays": [pa.array(c, k) for c, k in zip(columns, kinds)], "names": names}


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _blocks(docs: DataFrame, shards: int, block_chars: int) -> DataFrame:
    """Blocks of the corpus: a row ``tokens`` (word numbers; ids, sizes and flags of documents) and rows ``words`` for each shard."""

    def read(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal number, held
            ids, trains, lengths, hashes = (np.concatenate(c) for c in zip(*held))
            held = []
            words, which = np.unique(hashes, return_inverse=True)
            count = np.bincount(which, weights=np.repeat(trains, lengths), minlength=len(words)).astype(np.uint32)
            other = np.bincount(which, minlength=len(words)) - count  # outside training texts
            block = (part << 24) + number
            number += 1
            docs_of = np.stack([ids, lengths, trains.astype(np.int64)], axis=1)
            # frequent words get low numbers: two bytes are enough for most tokens
            often = np.argsort(-np.bincount(which, minlength=len(words)), kind="stable")
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            out = [(block, -1, "tokens", _short(rank[which]), *_bytes(docs_of, words[often]), None, None, None, None)]
            order, shard = _by_shard(words, shards)
            words, count, other, shard = words[order], count[order], other[order], shard[order]
            bounds = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.unique(shard).tolist():
                own = slice(bounds[s], bounds[s + 1])
                out.append((block, s, "words", *_bytes(words[own], count[own]), _packed(other[own]), None, None, None, None))
            return pa.RecordBatch.from_arrays(**_rows(out))

        size = 0
        for batch in batches:
            texts = texts_of(batch)
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            train = ~batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            start = 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1])
                if size >= block_chars or stop == len(texts):
                    data, a, b, owner = words_of(texts[start:stop])
                    held.append((ids[start:stop], train[start:stop], np.bincount(owner, minlength=stop - start), word_hashes(data, a, b)))
                    start = stop
                    if size >= block_chars:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return docs.mapInArrow(read, MESSAGE)


def _by_shard(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by shard and hash, and the shard of each."""
    shard = (words % np.uint64(shards)).astype(np.int64)
    return np.lexsort((words, shard)), shard


def _short(numbers: np.ndarray) -> bytes:
    """Numbers in two bytes; larger ones follow in four."""
    head = np.minimum(numbers, 65535).astype(np.uint16)
    return struct.pack("<q", len(head)) + head.tobytes() + numbers[head == 65535].astype(np.uint32).tobytes()


def _long(data: bytes) -> np.ndarray:
    n = struct.unpack_from("<q", data)[0]
    out = np.frombuffer(data, np.uint16, n, 8).astype(np.int64)
    out[out == 65535] = np.frombuffer(data[8 + 2 * n :], np.uint32)
    return out


def _slices(occurrences: np.ndarray, shards: int, slice_tokens: int) -> np.ndarray:
    """Number of slices, each in a shard of its own, that the successors of a context are dealt to."""
    return np.clip(-(-occurrences // slice_tokens), 1, shards)


def _count_words(table: pa.Table, shards: int, slice_tokens: int) -> pa.Table:
    """In a shard of the vocabulary: the counts of each block's words, those dealt to several slices, and totals."""
    words = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    every, which = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(which, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("b").to_pylist()]), minlength=len(every)).astype(np.int64)
    other = np.bincount(which, weights=np.concatenate([_unpacked(x) for x in table.column("c").to_pylist()]), minlength=len(every)).astype(np.int64)
    slices = _slices(count + other, shards, slice_tokens)
    out, at = [], 0
    for block, shard, own in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), words):
        mine = which[at : at + len(own)]
        at += len(own)
        many = np.flatnonzero(slices[mine] > 1)
        out.append((block, shard, "counts", _packed(count[mine]), np.stack([many, slices[mine][many]]).tobytes(), None, None, None, None, None))
    shard = table.column("shard")[0].as_py()
    out.append((-1, shard, "totals", None, None, None, int((count == 1).sum()), int((count == 2).sum()), int((count > 0).sum()), int(count.sum())))
    return pa.Table.from_arrays(**_rows(out))


class _Block:
    """Tokens of a block with counts: for every token, its word's count, its context and its number as a bigram.

    A frequent context has its successors dealt to slices, in shards one after the other; its head goes to each.
    """

    def __init__(self, table: pa.Table, shards: int, ends: int, begins: int):
        kind = table.column("kind").to_pylist()
        row = kind.index("tokens")
        self.block = table.column("block")[row].as_py()
        which = _long(table.column("a")[row].as_py())
        self.docs = np.frombuffer(table.column("b")[row].as_py(), np.int64).reshape(-1, 3)
        words = np.frombuffer(table.column("c")[row].as_py(), np.uint64)
        answers = sorted((table.column("shard")[i].as_py(), table.column("a")[i].as_py(), table.column("b")[i].as_py()) for i, k in enumerate(kind) if k == "counts")
        count, slices = np.zeros(len(words), np.int64), np.ones(len(words) + 1, np.int64)
        place, at = _by_shard(words, shards)[0], 0
        for _, counted, many in answers:
            counted, many = _unpacked(counted), np.frombuffer(many, np.int64).reshape(2, -1)
            count[place[at : at + len(counted)]] = counted
            slices[place[at + many[0]]] = many[1]
            at += len(counted)
        slices[-1] = begins
        # one more word: the end of a text, and for contexts its begin
        n, size = len(words), self.docs[:, 1]
        self.count = np.append(count, ends)
        begin = np.cumsum(size + 1) - size - 1
        tokens = np.full(int((size + 1).sum()), n, np.int64)
        tokens[ragged(begin, size)] = which
        before = np.concatenate([[n], tokens[:-1]])
        before[begin] = n
        self.tokens, self.doc = tokens, np.repeat(np.arange(len(size)), size + 1)
        context, word = np.append(words, BEGIN), np.append(words, END)
        home = (mixed(context) % np.uint64(shards)).astype(np.int64)
        short = (mixed(word ^ np.uint64(0x452821E638D01377)) >> np.uint64(32)).astype(np.uint32)
        pair, self.pair_of = np.unique(before * (n + 1) + tokens, return_inverse=True)
        of = pair // (n + 1)
        self.context, self.word = context[of], short[pair % (n + 1)]
        train = self.docs[:, 2][self.doc]
        self.pair_count = np.bincount(self.pair_of, weights=train, minlength=len(pair)).astype(np.uint32)
        # questions in the order (shard, context, word)
        shard = (home[of] + self.word % slices[of]) % shards
        self.order = np.lexsort((self.word, self.context, shard))
        self.shard, self.pair_context = shard[self.order], of
        # heads in the order (shard, context), also those of slices that this block has no word in
        used = np.unique(of)
        head = np.repeat(used, slices[used])
        head_shard = (home[head] + ragged(np.zeros(len(used), np.int64), slices[used])) % shards
        order = np.lexsort((context[head], head_shard))
        self.head, self.head_shard = head[order], head_shard[order]
        self.head_context, self.head_total, self.head_sliced = context[self.head], self.count[self.head], slices[self.head] > 1
        key = self.head_shard * (n + 1) + self.head
        by_key = np.argsort(key)
        self.runs = np.zeros(len(key), np.uint32)
        self.runs[by_key] = np.bincount(np.searchsorted(key[by_key], shard * (n + 1) + of), minlength=len(key))


def _ask(table: pa.Table, shards: int, ends: int, begins: int) -> pa.Table:
    """A block's distinct bigrams: contexts with their numbers of words, the words, and counts in training texts."""
    b = _Block(table, shards, ends, begins)
    word, count = b.word[b.order], b.pair_count[b.order]
    bounds, heads = (np.searchsorted(x, np.arange(shards + 1)) for x in (b.shard, b.head_shard))
    out = []
    for s in np.unique(b.head_shard).tolist():
        own, top = slice(bounds[s], bounds[s + 1]), slice(heads[s], heads[s + 1])
        h, sliced = b.head_context[top], np.flatnonzero(b.head_sliced[top])
        small = np.minimum(count[own], 255).astype(np.uint8)
        big = count[own][small == 255]
        head = h.tobytes() + b.runs[top].tobytes() + sliced.tobytes() + b.head_total[top][sliced].tobytes()
        out.append((b.block, s, "ask", head, word[own].tobytes(), small.tobytes() + big.tobytes(), None, None, len(h), len(small)))
    return pa.Table.from_arrays(**_rows(out))


def _unpack_ask(heads: bytes, words: bytes, counts: bytes, types: int, tokens: int):
    head = np.frombuffer(heads, np.uint64, types)
    context = np.repeat(head, np.frombuffer(heads, np.uint32, types, 8 * types))
    sliced = np.frombuffer(heads[12 * types :], np.int64).reshape(2, -1)
    count = np.frombuffer(counts, np.uint8, tokens).astype(np.int64)
    count[count == 255] = np.frombuffer(counts, np.uint32, -1, tokens) if len(counts) > tokens else 255
    return context, np.frombuffer(words, np.uint32), count, head, head[sliced[0]], sliced[1]


def _answer(table: pa.Table) -> pa.Table:
    """In a shard of contexts: build the trie from all blocks' counts, and answer each block from it."""
    asked = [_unpack_ask(*x) for x in zip(*(table.column(c).to_pylist() for c in ("a", "b", "c", "types", "tokens")))]
    context, word, count, _, sliced, total = (np.concatenate(c) for c in zip(*asked))
    keep = count > 0
    order = np.lexsort((word[keep], context[keep]))
    h, w, c = context[keep][order], word[keep][order], count[keep][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    trie = Trie(Trie.build(h[first], w[first], np.add.reduceat(c, first), (sliced, total))) if len(h) else None
    out = []
    for block, shard, (own_h, own_w, _, head, _, _) in zip(table.column("block").to_pylist(), table.column("shard").to_pylist(), asked):
        code = trie.query(own_h, own_w)[0] if trie else np.zeros(len(own_h), np.uint16)
        weight = trie.weights(head) if trie else np.zeros(len(head), np.uint16)
        out.append((block, shard, "answer", code.tobytes(), weight.tobytes(), None, None, None, None, None))
    return pa.Table.from_arrays(**_rows(out))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key, table: pa.Table, answers: pa.Table, shards: int, totals: dict) -> pa.Table:
    b = _Block(table, shards, totals["ends"], totals["begins"])
    n, v = totals["tokens"], totals["types"]
    order = np.argsort(answers.column("shard").to_numpy(), kind="stable").tolist()
    code = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(answers.column("a")[i].as_py(), np.uint16) for i in order)])
    weights = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(answers.column("b")[i].as_py(), np.uint16) for i in order)])
    own = np.empty(len(code))
    own[b.order] = probability(code)
    # the slices of a context each leave a part of its mass; without a part it was never seen
    left = np.bincount(b.head, weights=probability(weights), minlength=len(b.count))
    weight = np.where(left > 0, left, 1.0)[b.pair_context]
    count = b.count[b.tokens]
    if n:
        d = totals["n1"] / (totals["n1"] + 2 * totals["n2"]) if totals["n1"] else 0.5
        d = min(max(d, 0.05), 0.95)
        one = np.where(count > 0, (count - d) / n, d * v / n)
    else:
        one = np.ones(len(count))
    p = np.minimum(own[b.pair_of] + weight[b.pair_of] * one, 1.0)
    docs = len(b.docs)
    size = b.docs[:, 1] + 1
    known = np.bincount(b.doc, weights=count > 0, minlength=docs).astype(np.int64)
    base = np.bincount(b.doc, weights=np.log10((count + 1) / (n + v + 1)), minlength=docs)
    score = np.bincount(b.doc, weights=np.log10(p), minlength=docs)
    ids = b.docs[:, 0]
    return pa.table(
        [pa.array(ids, mask=ids == -(2**63)), pa.array(b.docs[:, 2] == 0), pa.array(size), pa.array(known), pa.array(np.full(docs, n)), pa.array(base), pa.array(score)],
        names=[f.split()[0] for f in SCORES.split(", ")],
    )


def score_documents(docs: DataFrame, held: Column, *, block_chars: int = 12_000_000, shard_bytes: int = 16 << 20, slice_tokens: int = 1 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``doc_id, text``.

    The model learns from the rows where ``held`` is false. Tokens are the words of the text, A-Z lowered,
    and one end. ``base_score`` is add-one unigrams. A null text is empty and has its end alone; a null
    ``doc_id`` stays null; repeated rows count and are scored each; other columns are not read; without
    training rows every token is unknown and ``score`` is 0; an empty table gives no rows. Words are told
    apart by hashes of 64 bits, successors of one context by 32. A context met more than ``slice_tokens``
    times has its successors dealt to several shards, each with the context's total.
    """
    shards = shards_for(text_bytes(docs), shard_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    ends, texts = rows.agg(F.count_if(~F.col("held")), F.count("*")).first()
    begins = int(_slices(np.int64(texts), shards, slice_tokens))
    blocks = stored(_blocks(rows, shards, block_chars), "token-blocks")
    counts = stored(blocks.where("kind = 'words'").groupBy("shard").applyInArrow(lambda t: _count_words(t, shards, slice_tokens), MESSAGE), "word-counts")
    sums = counts.where("kind = 'totals'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "types", "tokens"))).first()
    totals = {"ends": ends, "begins": begins, "n1": sums.n1 + (ends == 1), "n2": sums.n2 + (ends == 2), "types": sums.types + (ends > 0), "tokens": sums.tokens + ends}
    known = blocks.where("kind = 'tokens'").union(counts.where("kind = 'counts'"))
    asked = known.groupBy("block").applyInArrow(lambda t: _ask(t, shards, ends, begins), MESSAGE)
    answers = asked.groupBy("shard").applyInArrow(_answer, MESSAGE)
    return known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda k, t, a: _score(k, t, a, shards, totals), SCORES)
