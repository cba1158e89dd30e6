"""A tokenizer compiled to deterministic transducers.

Two machines run after each other, both over whole batches of texts at once:

* the *splitter* reads character classes and marks where words (pre-tokens) start. It has nine states,
  so the effect of a chunk of text is a map from each entry state to an exit state. The maps of all
  chunks are found side by side, composed by a parallel prefix scan, and a second pass with the entry
  states known emits the marks.
* the *merger* reads the bytes of a word. A state holds what byte-pair encoding still has to know about
  the prefix read: every suffix of it that may grow into a token, with the token before that suffix and
  how many tokens lie between. A transition carries the change in the number of tokens and the state
  carries the last token of its prefix, so counts and ids both come from table look-ups. The machine is
  determinised on demand: transitions are compiled when first met and kept in flat tables; the tables
  start afresh when they reach ``max_states``, so memory is bounded and results do not change.

The classes of characters and their normal forms are asked of the tokenizer file's own library, one
character at a time, so that its tables and not Python's decide.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .frames import held

# character classes
SPACE, LETTER, NUMBER, OTHER, QUOTE, S, T, M, D, R, V, L, E = range(13)
_LETTERS = {"'": QUOTE, "s": S, "t": T, "m": M, "d": D, "r": R, "v": V, "l": L, "e": E}
# splitter states
GAP, WORD, DIGIT, MARKS, TICK, TICK_R, TICK_V, TICK_L, CLOSED = range(9)
HERE, BEFORE = 1, 2  # a word starts at this character, at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted starts for each (state, class); contractions win over runs of marks."""
    step = np.zeros((9, 13), np.uint8)
    emit = np.zeros((9, 13), np.uint8)
    letters = (LETTER, S, T, M, D, R, V, L, E)
    pending = {TICK_R: E, TICK_V: E, TICK_L: L}
    for state in range(9):
        late = BEFORE if state in pending else 0  # the letter held back began a word after all
        step[state, SPACE], emit[state, SPACE] = GAP, late
        step[state, NUMBER], emit[state, NUMBER] = DIGIT, HERE | late
        for mark, to in ((OTHER, MARKS), (QUOTE, TICK)):
            inside = state in (MARKS, TICK)
            step[state, mark] = MARKS if inside else to
            emit[state, mark] = 0 if inside else HERE | late
        for c in letters:
            step[state, c] = WORD
            emit[state, c] = 0 if state == WORD else late or HERE
        if state in pending:
            step[state, pending[state]], emit[state, pending[state]] = CLOSED, 0
    for c in (S, T, M, D):
        step[TICK, c], emit[TICK, c] = CLOSED, 0
    for c, to in ((R, TICK_R), (V, TICK_V), (L, TICK_L)):
        step[TICK, c], emit[TICK, c] = to, 0
    return step, emit


STEP, EMIT = _splitter()


def word_starts(classes: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Mark the first character of every word. ``classes`` must end in a space."""
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.zeros(rows * chunk, np.uint8)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat, width = STEP.ravel(), STEP.shape[1]
    state = np.zeros(rows, np.uint8)
    if rows > 1:
        maps = _chunk_maps(columns, flat, width)
        # inclusive scan: after each round a row holds the map of twice as many chunks
        reach = 1
        while reach < rows:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
            reach *= 2
        state[1:] = maps[:-1, GAP]
    marks = np.empty((chunk, rows), np.uint8)
    emit = EMIT.ravel()
    for k, column in enumerate(columns):
        at = state * np.uint8(width) + column  # below 117, so it fits in a byte
        marks[k] = emit[at]
        state = flat[at]
    marks = np.ascontiguousarray(marks.T).reshape(-1)[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


def _chunk_maps(columns: np.ndarray, flat: np.ndarray, width: int) -> np.ndarray:
    """Exit state of each chunk for each entry state. A chunk whose states have met is followed once."""
    rows = columns.shape[1]
    maps = np.repeat(np.arange(9, dtype=np.uint8)[None], rows, axis=0)
    open_rows = np.arange(rows)
    one = np.zeros(rows, np.uint8)
    met = np.zeros(rows, bool)
    for k, column in enumerate(columns):
        if len(open_rows):
            part = flat[maps[open_rows] * np.uint8(width) + column[open_rows, None]]
            maps[open_rows] = part
        if met.any():
            one = flat[one * np.uint8(width) + column]
        if len(open_rows) and k % 4 == 3:
            same = (part == part[:, :1]).all(1)
            done = open_rows[same]
            one[done], met[done] = part[same, 0], True
            open_rows = open_rows[~same]
    maps[met] = one[met, None]
    return maps


class Transducer:
    """Counts and ids for a byte-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str, max_states: int = 200_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>":
            raise ValueError("a BPE tokenizer with the end-of-word suffix </w> is expected")
        self.library = Tokenizer.from_file(path)
        self.max_states = max_states
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._symbols(model)
        self._reset()
        # what a character becomes and its class; filled when first met
        self.lower = np.full(0x110000, -1, np.int32)
        self.kind = np.full(0x110000, 255, np.uint8)
        self.kind[0], self.lower[0] = 255, -1

    # ------------------------------------------------------------------ characters
    def _meet(self, points: np.ndarray) -> None:
        """Ask the library for the normal form and class of characters not met before."""
        for p in points.tolist():
            if 0xD800 <= p <= 0xDFFF:
                form = "�"
            else:
                form = self.library.normalizer.normalize_str(chr(p))
            self.lower[p] = ord(form) if len(form) == 1 else -2
            for c in form:
                if self.kind[ord(c)] == 255:
                    self.kind[ord(c)] = self._class(c)

    def _class(self, c: str) -> int:
        if c in _LETTERS:
            return _LETTERS[c]
        split = self.library.pre_tokenizer.pre_tokenize_str
        after = split("a" + c)
        if len(after) == 1:
            return LETTER if after[0][1] == (0, 2) else SPACE
        return OTHER if len(split(c + c)) == 1 else NUMBER

    def normal(self, text: str) -> np.ndarray:
        """Code points after normalisation, by table where every character stands for itself."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
        if not len(points):
            return points.astype(np.int32)
        low = self.lower[points]
        if (low == -1).any():
            self._meet(np.unique(points[low == -1]))
            low = self.lower[points]
        if points.max() >= 0x300 and not unicodedata.is_normalized("NFC", text) or (low == -2).any():
            return self._slow(text)
        if points.max() >= 0x300 and not text.isprintable() and (points >= 0x0530).any():
            return self._slow(text)  # letters outside the tables of either library: leave it to the tokenizer's
        return low

    def _slow(self, text: str) -> np.ndarray:
        form = self.library.normalizer.normalize_str(text)
        points = np.frombuffer(form.encode("utf-32-le"), np.uint32).astype(np.int32)
        new = np.unique(points[self.kind[points] == 255]) if len(points) else points
        for p in new.tolist():
            self.kind[p] = self._class(chr(p))
        return points

    # ------------------------------------------------------------------ merges
    def _symbols(self, model: dict) -> None:
        vocab = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        # the printable stand-in of each byte, as the byte-level alphabet defines it
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        stand_in = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.base = np.array([[vocab[stand_in[b]] for b in range(256)], [vocab[stand_in[b] + "</w>"] for b in range(256)]])
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        parts: dict[int, tuple[int, ...]] = {int(t): (int(t),) for t in self.base.ravel()}
        for (a, b), (_, t) in self.rank.items():
            parts[t] = parts[a] + parts[b]
        self.parts = parts
        self.length = np.ones(self.size, np.int32)
        trie: dict[tuple[int, int], int] = {}
        token_at: list[int] = [-1]
        inner: list[bool] = [False]
        for t, symbols in parts.items():
            self.length[t] = len(symbols)
            if self.merge(symbols) != [t]:
                continue  # no text is ever encoded with it
            node = 0
            for s in symbols:
                inner[node] = True
                node = trie.setdefault((node, s), len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
                    inner.append(False)
            token_at[node] = t
        self.trie, self.token_at, self.inner = trie, token_at, inner
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, symbols) -> list[int]:
        """Plain byte-pair encoding of a short run of symbols: lowest rank first, leftmost on ties."""
        out, rank = list(symbols), self.rank
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                found = rank.get((out[i], out[i + 1]))
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            out[at : at + 2] = [best[1]]
        return out

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are next to each other."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.merge(self.parts[left] + self.parts[right]) == [left, right]
        return found

    # ------------------------------------------------------------------ lazy tables
    def _reset(self) -> None:
        self.keys: list[tuple] = [((0, -1, 0),)]
        self.number: dict[tuple, int] = {self.keys[0]: 0}
        self.columns = np.full(256, -1, np.int32)
        self.used = 0
        # next state and, in the low five bits, the change in the number of tokens plus 16
        self.next = np.full((1024, 32), -1, np.int32)
        self.last = np.full(1024, -1, np.int32)
        self.end_add = np.full((1024, 32), -128, np.int8)
        self.end_last = np.zeros((1024, 32), np.uint16 if self.size <= 1 << 16 else np.int32)

    def _fit(self) -> None:
        rows, columns = self.next.shape
        if len(self.keys) <= rows and self.used <= columns:
            return
        # tables grow by a quarter: doubling them would leave up to half of a worker's memory empty
        while len(self.keys) > rows:
            rows += max(1024, rows // 4)
        while self.used > columns:
            columns += 16
        for name, fill in (("next", -1), ("end_add", -128), ("end_last", 0)):
            old = getattr(self, name)
            new = np.full((rows, columns), fill, old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)
        self.last = np.concatenate([self.last, np.full(rows - len(self.last), -1, np.int32)])

    def _token(self, key: tuple, symbol: int) -> tuple[int, int, list]:
        """Last token after one more symbol, change in the number of tokens, suffixes that still grow."""
        token, change, grown = -1, 0, []
        for node, before, behind in key:
            child = self.trie.get((node, symbol))
            if child is None:
                continue
            if self.inner[child]:
                grown.append((child, before, behind))
            t = self.token_at[child]
            if t >= 0 and token < 0 and (before < 0 or self._side_by_side(before, t)):
                token, change = t, behind + 1
        return token, change, grown

    def _compile(self, state: int, byte: int, final: bool) -> None:
        column = self.columns[byte]
        if final:
            token, change, _ = self._token(self.keys[state], int(self.base[1, byte]))
            self.end_add[state, column], self.end_last[state, column] = change, token
            return
        token, change, grown = self._token(self.keys[state], int(self.base[0, byte]))
        key = (*((node, before, behind - change) for node, before, behind in grown), (0, token, 0))
        to = self.number.setdefault(key, len(self.keys))
        if to == len(self.keys):
            self.keys.append(key)
            self._fit()
            self.last[to] = token
        if not -16 <= change < 16:
            raise ValueError("a change in the number of tokens does not fit its five bits")
        self.next[state, column] = to << 5 | change + 16

    def _columns_of(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.columns[b] < 0:
                self.columns[b] = self.used
                self.used += 1
        self._fit()
        return self.columns[data]

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: bool = False):
        """Tokens of each word (bytes ``data[start:end]``); with ``ids``, also the token ids in order.

        All words step forward together; a word drops out at its last byte.
        """
        if len(self.keys) > self.max_states:
            self._reset()
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        symbols = self._columns_of(data)
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, size = starts[order], size[order]
        state = np.zeros(len(begin), np.int64)
        count = np.zeros(len(begin), np.int32)
        tail = np.full(len(data), -1, np.int32) if ids else None
        # how many words are longer than k, for every k
        longer = len(size) - np.cumsum(np.bincount(size))
        for k in range(int(size[0])):
            alive = len(size) if k == 0 else int(longer[k])
            going = int(longer[k + 1])
            at = begin[:alive] + k
            symbol = symbols[at]
            if going:
                a, s = state[:going], symbol[:going]
                wide = self.next.shape[1]
                cell = a * wide + s
                to = self.next.ravel()[cell]
                if to.min() < 0:
                    missing = to < 0
                    self._fill(a[missing], data[at[:going][missing]], False)
                    cell = a * self.next.shape[1] + s
                    to = self.next.ravel()[cell]
                count[:going] += (to & 31) - 16
                to >>= 5
                state[:going] = to
                if ids:
                    tail[at[:going]] = self.last[to]
            if going < alive:
                a, s = state[going:alive], symbol[going:]
                plus = self.end_add[a, s]
                if plus.min() == -128:
                    missing = plus == -128
                    self._fill(a[missing], data[at[going:][missing]], True)
                    plus = self.end_add[a, s]
                count[going:alive] += plus
                if ids:
                    tail[at[going:]] = self.end_last[a, s]
        counts = np.empty(len(begin), np.int64)
        counts[order] = count
        if not ids:
            return counts, np.zeros(0, np.int32)
        keep = np.zeros(len(data), bool)
        left, right = starts.copy(), ends.copy()
        while len(right):  # from the end of each word back, one token at a time
            keep[right - 1] = True
            right = right - self.length[tail[right - 1]]
            more = right > left
            left, right = left[more], right[more]
        return counts, tail[keep]

    def _fill(self, states: np.ndarray, data: np.ndarray, final: bool) -> None:
        pairs = np.unique(states.astype(np.int64) * 256 + data)
        for pair in pairs.tolist():
            self._compile(pair >> 8, pair & 255, final)

    # ------------------------------------------------------------------ texts
    def encode(self, texts: list[str], ids: bool = False):
        """Number of tokens of each text; with ``ids``, also all ids, text after text.

        Special tokens that stand in a text count as one token each, as the library has it.
        """
        pieces: list[np.ndarray] = []
        owner: list[int] = []
        extra: dict[int, list[tuple[int, int]]] = {}  # text: (pieces before, id)
        gap = np.array([32], np.int32)
        for i, text in enumerate(texts):
            spans = [text]
            if self.cut is not None and "<|" in text:
                spans, at = [], 0
                for found in self.cut.finditer(text):
                    spans.append(text[at : found.start()])
                    extra.setdefault(i, []).append((len(pieces) + len(spans), self.special[found.group()]))
                    at = found.end()
                spans.append(text[at:])
            for span in spans:
                owner.append(i)
                pieces.append(np.concatenate([self.normal(span), gap]))
        if self.kind[32] == 255:
            self._meet(np.array([32]))
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        points = np.concatenate(pieces)
        classes = self.kind[points]
        starts = word_starts(classes)
        solid = classes != SPACE
        first = np.flatnonzero(starts)
        # a word ends where the next begins or at the first space
        stop = np.empty(len(points) + 1, bool)
        stop[:-1] = starts | ~solid
        stop[-1] = True
        closing = np.flatnonzero(stop[1:] & solid) + 1
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
        counts, tokens = self.run(data, offset[first], offset[closing], ids)
        edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        by_piece = np.add.reduceat(np.concatenate([counts, [0]]), np.minimum(np.searchsorted(first, edges[:-1]), len(counts)))
        bounds = np.searchsorted(first, edges)
        by_piece[bounds[1:] == bounds[:-1]] = 0
        total = np.bincount(np.array(owner), weights=by_piece, minlength=len(texts)).astype(np.int64)
        if extra:
            if ids:
                ends = np.cumsum(by_piece)
                put = [(int(ends[p - 1]), t) for i in extra for p, t in extra[i]]
                tokens = np.insert(tokens, [p for p, _ in put], [t for _, t in put])
            for i, found in extra.items():
                total[i] += len(found)
        return total, tokens


def transducer(path: str, max_states: int = 200_000) -> Transducer:
    """One machine in a worker process; it keeps what it has compiled, up to ``max_states``."""
    return held((path, max_states), lambda: Transducer(path, max_states))
