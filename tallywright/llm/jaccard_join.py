"""Near-duplicate documents: an exact Jaccard join on word shingles with a count-vector R-tree.

Shingles are hashed into groups and a document is the point of its counts by group. Two documents share
at most the sum of coordinate minima, so the boxes of an R-tree over the points bound the overlap with
whole subtrees, and only pairs that survive are verified on the shingles themselves.

Counts alone can't keep points of a whole corpus apart, so the trees are local to buckets, the documents
that share a shingle. In any common order, documents that link share the first of their common shingles
within a quarter of their own, and the first eighth of them within three eighths (prefix filter). So

* each set is posted under its first three eighths, frequent shingles last by a count sketch of fixed size;
* a set of which less than an eighth is found in another set's postings links with nothing and leaves;
* of the postings that others share, rarest first by their exact count among the sets that stay, a set
  enters as many buckets as it takes for two that link to meet: all but an eighth.

A passage that many documents share thus makes no buckets for documents that are otherwise their own.

1. Equal shingle sets are one class; buckets hold classes, and buckets with equal members count once.
2. In each bucket, in blocks if it is large, the R-tree finds the pairs whose counts leave room for a link.
   A spanning forest of them, closest pairs first, is verified: links in number linear in the bucket join
   most groups of near copies. This is done for the first buckets of each class, then for all buckets
   whose classes are still in several components.
3. In buckets that are so even then, all pairs of different components that the tree leaves are
   verified. No pair is dropped: a pair left out is already connected.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cell_parts, free_name, let_go, merged_cells, mixed, ragged, signed, sliced, stars, stored, summed_cells, texts_of, word_hashes, words_of

CELLS = 1 << 20
WORDS = 5


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the number of them in each text."""
    data, starts, ends, owner = words_of(texts)
    h = word_hashes(data, starts, ends)
    count = np.bincount(owner, minlength=len(texts))
    short = (count > 0) & (count < words)
    out, of = [], []
    if len(h) >= words:
        n = len(h) - words + 1
        g = np.zeros(n, np.uint64)
        for j in range(words):
            g = mixed(g + h[j : j + n] * np.uint64(2 * j + 3))
        whole = owner[:n] == owner[words - 1 :]
        out.append(g[whole])
        of.append(owner[:n][whole])
    if short.any():  # the whole sequence is the one shingle
        first = np.cumsum(count) - count
        for i in np.flatnonzero(short).tolist():
            g = np.zeros(1, np.uint64)
            for j in range(count[i]):
                g = mixed(g + h[first[i] + j : first[i] + j + 1] * np.uint64(2 * j + 101))
            out.append(g)
            of.append(np.array([i]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    g, of = np.concatenate(out), np.concatenate(of)
    if short.any():
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
    sort_within(g, np.bincount(of, minlength=len(texts)))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[new], np.bincount(of[new], minlength=len(texts))


def sort_within(values: np.ndarray, sizes: np.ndarray) -> None:
    """Sort the stretches of ``sizes`` in place, each for itself."""
    start = 0
    for stop in np.cumsum(sizes).tolist():
        values[start:stop].sort()
        start = stop


def set_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set, the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(sizes)
    return mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64))


def groups_for(size: int) -> int:
    """Groups of a set's count vector: four or more for each shingle, so unlike shingles seldom fall together."""
    return min(1 << 16, max(64, 1 << (4 * max(size, 1) - 1).bit_length()))


def count_vector(values: np.ndarray) -> bytes:
    """The count vector as sorted group numbers: two low bits of each, the rest in unary steps."""
    groups = groups_for(len(values))
    group = np.sort(((values >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64))
    steps = np.zeros(groups // 4 + len(group), np.uint8)
    steps[(group >> 2) + np.arange(len(group))] = 1
    low = np.stack([group & 1, group >> 1 & 1], axis=1).astype(np.uint8)
    return np.packbits(steps).tobytes() + np.packbits(low).tobytes()


def groups_of(vector: bytes, size: int) -> np.ndarray:
    """The sorted group numbers of a set of ``size`` shingles."""
    bits = np.unpackbits(np.frombuffer(vector, np.uint8))
    steps = groups_for(size) // 4 + size
    low = bits[-(-steps // 8) * 8 :][: 2 * size]
    high = np.flatnonzero(bits[:steps]) - np.arange(size)
    return high << 2 | low[1::2].astype(np.int64) << 1 | low[::2]


def numbered_groups(group: np.ndarray) -> np.ndarray:
    """Sorted group numbers, told apart by a running number: common ones of two rows sum up to their minima."""
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    at = np.arange(len(group))
    return group << 32 | at - np.maximum.accumulate(np.where(new, at, 0))


class Points:
    """Count vectors of a block, as the group numbers of each."""

    def __init__(self, vectors: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        self.group = np.concatenate([groups_of(v, n) for v, n in zip(vectors, sizes.tolist())])

    def _cells(self, index: np.ndarray, groups: int) -> np.ndarray:
        group = self.group[ragged(self.starts[index], self.sizes[index])]
        return np.repeat(np.arange(len(index)) * groups, self.sizes[index]) + (group & (groups - 1))

    def counts(self, index: np.ndarray, groups: int) -> np.ndarray:
        """Counts by group; groups that fall together in a narrower vector are added."""
        found = np.bincount(self._cells(index, groups), minlength=len(index) * groups)
        return found.astype(np.uint16 if found.max(initial=0) < 1 << 16 else np.uint32).reshape(len(index), groups)

    def planes(self, index: np.ndarray, groups: int) -> list[np.ndarray]:
        """Bits by group whether a count is at least 1, 2, ...: common bits of two rows sum up to their minima."""
        cell, count = np.unique(self._cells(index, groups), return_counts=True)
        out = []
        for least in range(1, int(count.max(initial=0)) + 1):
            cell, count = cell[count >= least], count[count >= least]
            plane = np.zeros(len(index) * groups // 64, np.uint64)
            words = cell >> 6
            edges = np.flatnonzero(np.diff(words, prepend=-1))
            plane[words[edges]] = np.bitwise_or.reduceat(np.uint64(1) << (cell & 63).astype(np.uint64), edges)
            out.append(plane.reshape(len(index), groups // 64))
        return out


class CountTree:
    """Packed R-tree over count vectors of one width; nodes keep upper corners and least sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fan: int = 8):
        self.order = self._packed(vectors, sizes, fan)
        self.levels = [(vectors[self.order], sizes[self.order])]
        self.fan = fan
        while len(self.levels[-1][1]) > 1:
            top, least = self.levels[-1]
            cuts = np.arange(0, len(least), fan)
            self.levels.append((np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts)))

    @staticmethod
    def _packed(vectors: np.ndarray, sizes: np.ndarray, fan: int) -> np.ndarray:
        """Order of the points in which runs of ``fan`` lie close: halves by the widest coordinate."""
        out, todo = [], [np.argsort(sizes, kind="stable")]
        while todo:
            part = todo.pop()
            if len(part) <= fan:
                out.append(part)
                continue
            axis = np.ptp(vectors[part], axis=0).argmax()
            part = part[np.argsort(vectors[part, axis], kind="stable")]
            half = -(-len(part) // (2 * fan)) * fan
            todo += [part[half:], part[:half]]
        return np.concatenate(out)

    def _spans(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label below each node, by level."""
        out = [(labels[self.order], labels[self.order])]
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(out[-1][0]), self.fan)
            out.append((np.minimum.reduceat(out[-1][0], cuts), np.maximum.reduceat(out[-1][1], cuts)))
        return out

    def search(self, vectors: np.ndarray, sizes: np.ndarray, labels=None, block: int = 256):
        """Pairs (query, point) whose counts leave room for a Jaccard similarity of 3/4.

        ``labels`` gives labels of points and of queries, asked anew for each block of queries: nodes whose
        points all have the query's are passed over.
        """
        for start in range(0, len(sizes), block):
            q, s = vectors[start : start + block], sizes[start : start + block]
            if labels is not None:
                points, queries = labels()
                spans, mine = self._spans(points), queries[start : start + block]
            top = len(self.levels) - 1
            query = np.repeat(np.arange(len(s)), len(self.levels[top][1]))
            node = np.tile(np.arange(len(self.levels[top][1])), len(s))
            for level in range(top, -1, -1):
                corner, least = self.levels[level]
                if labels is not None:
                    lo, hi = spans[level]
                    other = (lo[node] != mine[query]) | (hi[node] != mine[query])
                    query, node = query[other], node[other]
                keep = np.zeros(len(query), bool)
                for a in range(0, len(query), 4096):
                    i, j = query[a : a + 4096], node[a : a + 4096]
                    keep[a : a + 4096] = enough(np.minimum(q[i], corner[j]).sum(1, dtype=np.int64), s[i], least[j])
                query, node = query[keep], node[keep]
                if level:
                    below = len(self.levels[level - 1][1])
                    query = np.repeat(query, self.fan)
                    node = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                    query, node = query[node < below], node[node < below]
            yield query + start, self.order[node]


def enough(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``shared`` of sets of ``a`` and ``b`` elements make 100 * intersection >= 75 * union."""
    return 7 * shared >= 3 * (a + b)


class Linked:
    """Labels of points: pairs of one label need no other. Pairs that are joined make one label of two."""

    def __init__(self, roots: np.ndarray):
        self.first = self.label = np.unique(roots, return_inverse=True)[1]

    def join(self, a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that join labels, those with most slack first; the labels are joined."""
        kept = forest(self.label[a], self.label[b], slack)
        up = np.arange(int(self.label.max(initial=-1)) + 1)
        for x, y in zip(self.label[a[kept]].tolist(), self.label[b[kept]].tolist()):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        self.label = up[self.label]
        return kept

    def left_out(self) -> bool:
        """Whether a label may hold more pairs than joined it: it holds three of the first labels."""
        pairs = np.unique(np.stack([self.label, self.first]), axis=1)
        return bool((np.bincount(pairs[0]) > 2).any())


def tree_pairs(
    sizes: np.ndarray, vectors: list[bytes], sides: np.ndarray, linked: Linked | None = None, coarse: int = 32, spanning: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs between points of side 0 and side 1 (of side 0 alone, if there is no side 1), and their bounds.

    Trees hold the counts in groups ``coarse`` times wider; what they leave is bounded by all groups. Pairs
    of one label are passed over. If ``spanning``, pairs are joined as they are found, neighbours in a tree
    first, so a group of near copies of any size gives as many pairs as join it.
    """
    inner, outer = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    alone = not len(outer)
    if len(sizes) <= 64:  # a handful of pairs is bounded one by one
        a, b = (x.ravel() for x in np.meshgrid(inner, inner if alone else outer, indexing="ij"))
        keep = 4 * np.minimum(sizes[a], sizes[b]) >= 3 * np.maximum(sizes[a], sizes[b])
        if alone:
            keep &= a < b
        if linked is not None:
            keep &= linked.label[a] != linked.label[b]
        a, b = a[keep], b[keep]
        if len(a) <= 160:
            a, b, shared = _few_pairs(sizes, vectors, a, b)
            if spanning:
                kept = linked.join(a, b, shared / (sizes[a] + sizes[b]))
                a, b, shared = a[kept], b[kept], shared[kept]
            return a, b, shared
    points = Points(vectors, sizes)
    kinds, kind = np.unique(sizes, return_inverse=True)
    width = np.array([groups_for(n) for n in kinds.tolist()], np.int64)[kind]
    outer = inner if alone else outer
    found = ([np.zeros(0, np.intp)], [np.zeros(0, np.intp)], [np.zeros(0, np.int64)])

    def bounded(a, b, fine_a, fine_b, i, j):
        """Of pairs of places i, j in the points a, b those with room for a link by all groups; joined, if spanning."""
        step = max(64, (1 << 23) // (64 * fine_a[0].shape[1]))
        out = []
        for start in range(0, len(i), step):
            x, y = i[start : start + step], j[start : start + step]
            if linked is not None:
                apart = linked.label[a[x]] != linked.label[b[y]]
                x, y = x[apart], y[apart]
            shared = np.zeros(len(x), np.int64)
            for p, q in zip(fine_a, fine_b):
                shared += np.bitwise_count(p[x] & q[y]).sum(1, dtype=np.int64)
            keep = enough(shared, sizes[a[x]], sizes[b[y]])
            x, y, shared = a[x[keep]], b[y[keep]], shared[keep]
            if spanning:
                kept = linked.join(x, y, shared / (sizes[x] + sizes[y]))
                x, y, shared = x[kept], y[kept], shared[kept]
            out.append((x, y, shared))
        return out

    for groups in np.unique(width[inner]).tolist():
        held = inner[width[inner] == groups]
        for other in (groups // 2, groups, groups * 2):  # sizes that may link differ by one width at most
            asked = outer[width[outer] == other]
            if not len(asked):
                continue
            common = min(groups, other)
            wide = max(8, common // coarse)
            fine_held, fine_asked = points.planes(held, common), points.planes(asked, common)
            tree = CountTree(points.counts(held, wide), sizes[held])
            if spanning and alone and other == groups:  # held and asked are the same
                for part in bounded(held, held, fine_held, fine_held, tree.order[:-1], tree.order[1:]):
                    for column, values in zip(found, part):
                        column.append(values)
            labels = None if linked is None else lambda: (linked.label[held], linked.label[asked])
            for q, p in tree.search(points.counts(asked, wide), sizes[asked], labels):
                if alone:
                    q, p = (x[asked[q] < held[p]] for x in (q, p))
                for part in bounded(asked, held, fine_asked, fine_held, q, p):
                    for column, values in zip(found, part):
                        column.append(values)
    return tuple(np.concatenate(c) for c in found)


def _few_pairs(sizes: np.ndarray, vectors: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs given, those whose counts leave room for a link, and their bounds."""
    rows: dict[tuple[int, int], np.ndarray] = {}

    def row(i: int, groups: int) -> np.ndarray:
        if (i, groups) not in rows:
            n = int(sizes[i])
            group = groups_of(vectors[i], n)
            rows[i, groups] = numbered_groups(group if groups_for(n) == groups else np.sort(group & (groups - 1)))
        return rows[i, groups]

    shared = np.zeros(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        groups = min(groups_for(int(sizes[i])), groups_for(int(sizes[j])))
        x, y = row(i, groups), row(j, groups)
        shared[k] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    keep = enough(shared, sizes[a], sizes[b])
    return a[keep], b[keep], shared[keep]


def forest(a: np.ndarray, b: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that span the components of all pairs, those with most slack first."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    order = np.argsort(-slack, kind="stable")
    for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(k)
    return np.array(out, np.intp)


# ---------------------------------------------------------------------- steps on Spark
def row_key():
    """A key of id and text that is never null: a null is passed over."""
    return F.xxhash64("doc_id", "text")


DESCRIBED = "doc_id long, row_key long, n long, class long, vector binary, k int, v binary"


def described(docs: DataFrame, slice_chars: int = 500_000) -> DataFrame:
    """``doc_id, row_key, n, class, vector`` of every row; class and vector are null for an empty set.

    Rows without ``n`` hold each task's part ``k, v`` of the count sketch over all shingles.
    """

    def describe(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("vector", pa.binary()), ("k", pa.int32()), ("v", pa.binary())])
        let_go()
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in sliced(batch, slice_chars):
                sets, sizes = shingles(texts_of(part))
                np.add.at(total, (sets & np.uint64(CELLS - 1)).astype(np.int64), 1)
                keys = set_keys(sets, sizes).view(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                columns = ([], [], [])
                for i, n in enumerate(sizes.tolist()):
                    columns[0].append(n)
                    columns[1].append(int(keys[i]) if n else None)
                    columns[2].append(count_vector(sets[edges[i] : edges[i + 1]]) if n else None)
                none = [pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), *none], schema=schema)
        for k, v in cell_parts(total):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in schema.types[:5]), pa.array([k], pa.int32()), pa.array([v], pa.binary())], schema=schema)

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(describe, DESCRIBED)


def frequency(described: DataFrame) -> np.ndarray:
    """Level of each cell of the count sketch: 0 up to twice the mean, then one more for each doubling."""
    count = merged_cells(described.where("n is null").select("k", "v"), CELLS)
    share = count / (2 * count.mean() + 1)
    return np.where(share >= 1, np.minimum(np.floor(np.log2(np.maximum(share, 1))) + 1, 30), 0).astype(np.uint8)


def asked_for(n):
    """How many common shingles two linked sets have at least among the postings of both, judged by one's size ``n``.

    Sets of a and b that link have an overlap of 3/4 of either; each posts what its overlap may leave out
    and ``n // 8 + 1`` more, so both post the first ``min(a, b) // 8 + 1`` common ones, and b >= 3/4 a.
    """
    return F.floor(F.ceil(3 * n / 4) / 8) + 1


def postings(docs: DataFrame, level: np.ndarray, slice_chars: int = 500_000) -> DataFrame:
    """``key, class``: the first shingles of every set, rare ones first, so that linked sets share several."""
    context = docs.sparkSession.sparkContext.broadcast(level)  # one byte for each cell of the sketch

    def post(batches):
        let_go()
        for batch in batches:
            for part in sliced(batch, slice_chars):
                sets, sizes = shingles(texts_of(part))
                keys = set_keys(sets, sizes)
                _, kept = np.unique(keys, return_index=True)  # copies within a slice are posted once
                once = np.zeros(part.num_rows, bool)
                once[kept] = True
                of = np.repeat(np.arange(part.num_rows), sizes)
                rank = (context.value[(sets & np.uint64(CELLS - 1)).astype(np.intp)].astype(np.uint64) << np.uint64(58)) | (sets >> np.uint64(6))
                sort_within(rank, sizes)
                place = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = (place < (sizes - (3 * sizes + 3) // 4 + sizes // 8 + 1)[of]) & once[of]
                yield pa.RecordBatch.from_arrays([signed(rank[keep]), signed(keys[of[keep]])], names=["key", "class"])

    return docs.select("text").mapInArrow(post, "key long, class long")


def shared_keys(batches):
    """From rows sorted by key, class: the distinct ones whose key has several classes.

    Reads on in batches and holds back one row, so a key of any number of rows passes through.
    """
    names = ["key", "class"]
    held = None  # a row, and whether the row before has its key
    for batch in batches:
        key, cls = (batch.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        if held is not None:
            key, cls = (np.concatenate([[h], x]) for h, x in zip(held[:2], (key, cls)))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[new], cls[new]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[0] = held is not None and held[2]
        keep = same.copy()
        keep[:-1] |= same[1:]
        held = (key[-1], cls[-1], bool(same[-1]))
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep])], names=names)
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held[:2]], names=names)


def met(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, class, n`` of the classes that share as many postings with others as one that links must."""
    shared = buckets.groupBy("class").agg(F.count("*").alias("shared"))
    able = classes.select("class", "n").join(shared, "class").where(F.col("shared") >= asked_for(F.col("n")))
    return buckets.select("key", "class").join(able.select("class", "n"), "class").select("key", "class", "n")


def entered(buckets: DataFrame) -> DataFrame:
    """``key, class, n`` of the buckets a class enters: of its shared postings the rarest, all but those asked for less one."""
    several = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    own = Window.partitionBy("class")  # a document's own shingles
    ranked = buckets.join(several, "key").select("key", "class", "n", F.row_number().over(own.orderBy("m", "key")).alias("turn"), F.count("*").over(own).alias("shared"))
    return ranked.where(F.col("turn") <= F.col("shared") - asked_for(F.col("n")) + 1).select("key", "class", "n")


def with_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class, text`` of the classes in ``pairs``: of one row each, found by its key, so rows without an id count too."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(classes.select("class", "first"), "class")
    wanted = stored(wanted, "wanted")
    bits = summed_cells(wanted.select("first"), partial(_spots, name="first"), 1 << 21) > 0
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 256 kB, whatever the input

    def likely(batches):
        for batch in batches:
            at = _spots(batch, "first")
            hit = (packed.value[at >> 3] >> (7 - (at & 7))) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    # most texts that nobody asks for stay where they are; rows of one id and text, or of one text and no id, send one
    some = docs.select(row_key().alias("first"), "text").mapInArrow(likely, "first long, text string")
    some = some.groupBy("first").agg(F.first("text").alias("text"))
    found = some.join(wanted.hint("shuffle_hash"), "first")
    return stored(found.select("class", "text"), "texts")


def _spots(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
    return (mixed(values.astype(np.int64).view(np.uint64)) >> np.uint64(43)).astype(np.int64)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that link, by their shingles. The text of ``a`` comes before those of its partners."""
    asked = pairs.join(texts.withColumnRenamed("class", "b"), "b").select("a", "b", "text")
    hubs = texts.join(pairs.select(F.col("a").alias("class")).distinct(), "class").select(F.col("class").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    # only a text of the class's own set counts
    rows = hubs.union(asked).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())

    def check(batches):
        hub, have = None, None
        for batch in batches:
            links = []
            for part in sliced(batch, 500_000):
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets, sizes = shingles(texts_of(part))
                keys = set_keys(sets, sizes).view(np.int64)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(part.num_rows):
                    own = sets[edges[k] : edges[k + 1]]
                    if b[k] is None:
                        if int(keys[k]) == a[k]:
                            hub, have = a[k], own.copy()  # without the rest of its slice
                    elif hub == a[k] and int(keys[k]) == b[k]:
                        shared = len(np.intersect1d(have, own, assume_unique=True))
                        if 7 * shared >= 3 * (len(have) + len(own)):
                            links.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _blocks(rows: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Rows of a bucket in blocks by size order, ``size`` shingles or so in each; each pair of blocks of a bucket is one group."""
    running = F.sum(F.col("n") + 64).over(Window.partitionBy("key").orderBy("n", "class").rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("block", F.floor(F.coalesce(running, F.lit(0)) / size))
    last = numbered.groupBy("key").agg(F.max("block").alias("last"))
    spread = numbered.join(last, "key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
    spread = spread.select("key", "class", "n", "root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.when(F.col("block") <= F.col("with"), 0).otherwise(1).alias("side"))
    return spread.join(vectors, "class")  # vectors travel to their groups and nowhere else


PAIR = "a long, b long, key long, more boolean"


def _tree_group(table: pa.Table, spanning: bool) -> pa.Table:
    """Pairs of classes of different roots that the tree leaves; if ``spanning``, a forest of them over the roots.

    ``more`` tells whether the forest may leave pairs of this group out.
    """
    n, root, cls = (table.column(c).to_numpy() for c in ("n", "root", "class"))
    linked = Linked(root)
    a, b, _ = tree_pairs(n, table.column("vector").to_pylist(), table.column("side").to_numpy(), linked, spanning=spanning)
    more = spanning and linked.left_out()
    a, b = cls[a], cls[b]
    key, more = np.full(len(a), table.column("key")[0].as_py(), np.int64), np.full(len(a), more)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "key": key, "more": more})


def _survivors(rows: DataFrame, vectors: DataFrame, block: int, spanning: bool) -> DataFrame:
    return _blocks(rows, vectors, block).groupBy("key", "i", "j").applyInArrow(lambda t: _tree_group(t, spanning), PAIR)


def near_duplicates(docs: DataFrame, *, block: int = 1 << 19, early_buckets: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``doc_id, text``.

    Documents link when 100 * intersection >= 75 * union of their distinct five-word shingles (with fewer
    words: the whole sequence as one). ``component_id`` is the least ``doc_id`` reachable by links. A null
    text, or one without words, has an empty set and links with nothing. Rows with a null ``doc_id`` link
    like others but give no ``component_id``; alone, theirs is null. Repeated rows are reported each; other
    columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = stored(described(docs), "shingle-sets")
    rows = both.where("n is not null")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("row_key").alias("first"), F.max("n").alias("n"), F.first("vector").alias("vector"))
    classes = stored(classes, "shingle-classes")
    keys = postings(docs, frequency(both)).repartition("key").sortWithinPartitions("key", "class")
    shared = stored(keys.mapInArrow(shared_keys, "key long, class long"), "shared-keys")
    buckets = stored(entered(stored(met(shared, classes), "met")), "buckets")
    # buckets with equal members count once
    members = buckets.groupBy("key").agg(F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("class")).alias("xor"), F.count("*").alias("m")).where("m > 1")
    one = members.groupBy("sum", "xor", "m").agg(F.min("key").alias("key")).select("key")
    placed = stored(buckets.join(one, "key").select("key", "class", "n"), "open-buckets")
    vectors = classes.select("class", "vector")

    # near copies share nearly all their buckets: the first few of each class join most of them; forests in
    # all buckets join what is left of the groups; the last step sees every pair still apart
    turn = F.row_number().over(Window.partitionBy("class").orderBy("key"))
    early = placed.withColumn("turn", turn).where(F.col("turn") <= early_buckets).select("key", "class", "n", F.col("class").alias("root"))
    pairs = tested = stored(_survivors(early, vectors, block, True).select("a", "b").distinct(), "forest-pairs")
    roots = stars(verified(pairs, with_texts(docs, classes, pairs)))  # a class that is not there is its own root
    full = placed
    for spanning in (True, False):
        rooted = full.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        rooted = rooted.join(apart, "key").select("key", "class", "n", "root")
        left = stored(_survivors(rooted, vectors, block, spanning), "tree-pairs")
        pairs = stored(left.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "tree-pairs")
        if not pairs.isEmpty():
            links = verified(pairs, with_texts(docs, classes, pairs))
            roots = stars(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))
            tested = tested.union(pairs)
        # a bucket whose forest held all its pairs has none left to verify
        full = placed.join(left.where("more").select("key").distinct(), "key", "left_semi")

    known = rows.select("doc_id", "n", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("top", F.coalesce("root", "class"))
    least = known.where("n > 0").groupBy("top").agg(F.min("doc_id").alias("component"))
    return known.join(least, "top", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each group of linked ones: that of the least ``doc_id``.

    Of rows with one ``doc_id`` and one text the first by the other columns stays. Rows without a ``doc_id`` stay.
    """
    keep = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    order = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    number = free_name(docs, "row_number")
    found = docs.join(keep, "doc_id", "left_semi").withColumn(number, F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order)))
    return found.where(F.col(number) == 1).select(*docs.columns).unionByName(docs.where("doc_id is null"))
