"""N-gram Jaccard join of documents by prefix trees.

Two documents link when the Jaccard similarity of their word-shingle sets reaches
a threshold; the join is exact (on 64-bit hashes of shingles) and returns each
document's component.

1. A task works on some millions of shingles at a time, a flush.  It sends each one
   once, by 32 bits of its hash and a bucket, with how many of the flush's sets have
   it; who has a repeated one stays with the flush's own row.  A bucket sums up in
   how many sets each is and answers the flushes that have shared ones.  So a shingle
   that a third of all documents have is one element for each flush.  The counts give
   the global order, the rarest first; what one set alone has goes no further.
2. By prefix filtering, two sets that link share a shingle among the first
   n - ceil(t n) + 1 of each.  Elements that one set alone has fill most prefixes
   whole, so few documents have anything to send on.
3. Where a shingle has several sets, the least is its leader, and each set is
   assigned to it once however many shingles they share: as many rows as there
   are shared shingles at most, never pairs.  The leader of a shingle that more than
   ``HOT_SETS`` sets have is the least of the flushes' least, joined back with a salt.
4. Each leader's group of sets becomes a trie, in an order that puts what most
   sets share first.  A set is looked up by walking the trie from the root with
   the overlap so far, shared by all sets below a node; a subtree goes when the
   shingles that remain can't raise the overlap enough.  Sets that are already
   connected aren't compared again, so a group sends fewer links than sets.
   Groups over ``GROUP_SHINGLES`` or ``GROUP_SETS`` are cut into blocks: each block's sets are compared
   with the leader's, and only sets that don't link with it meet all blocks.
5. Components of the links by repeated minimum with pointer jumping, one written
   table for each round.

Flushes are known again by their number, so ``docs`` must give a partition's rows in
one order, as tables on disk do.

Nulls, empty and odd rows: a null, empty or wordless text has an empty set, which
links with nothing; a text of fewer words than a shingle has its whole sequence
as the one shingle; a very long text has all its shingles in one flush; equal texts link; rows with one doc_id are one document in
the components, and each is returned; a null doc_id is carried with its
n_shingles and a null component_id, and takes no part; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, input_bytes, record_batch, slices, table, written

WORDS = 5
#: The threshold in hundredths.
THRESHOLD = 75
#: Documents whose ids are broadcast to pick their texts (8 bytes each).
BROADCAST_IDS = 1 << 20
#: Shingles, and sets, of a group that one task holds; larger ones are dealt out in blocks.
GROUP_SHINGLES, GROUP_SETS = 1 << 18, 256
#: Shingles, and sets, of a flush (one longer text has more of the former).
FLUSH, FLUSH_SETS = 4 << 20, 65_000
#: Sets from which on a shingle's sets don't meet in one task.
HOT_SETS = 1 << 16
#: Equal sets that more than one in so many rows have are broadcast, so no more names
#: than this are.
HOT_NAMES = 1 << 16

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_KEYS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)
#: An odd number whose powers and their inverses place each byte of a word.
_R = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[1]
    h = (h ^ (h >> np.uint64(29))) * _M[4]
    return h ^ (h >> np.uint64(32))


_powers = np.zeros(0, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of ``_R`` mod 2**64, n at least."""
    global _powers
    if len(_powers) < n:
        _powers = np.empty(1 << max(20, (n - 1).bit_length()), np.uint64)
        _powers[0] = 1
        done = 1
        while done < len(_powers):
            step = np.uint64(pow(_R, done, 1 << 64))
            _powers[done : 2 * done] = _powers[:done] * step
            done *= 2
    return _powers


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 ``data``, A-Z in lower case, and the
    words' starts."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    # Horner's rule for all words at once: what a byte adds is placed by its
    # distance from the word's end.
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    at = np.flatnonzero(~space)
    terms = _KEYS[_LOWER[data[at]]] * _power(int(size.max()) + 1)[end[word] - at]
    return _mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(size)[:-1]])) + size.astype(np.uint64) * _M[0]), start


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingles' hashes."""
    if not texts:
        return []
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    h, start = word_hashes(data)
    cuts = np.cumsum([len(t) + 1 for t in texts])
    ends = np.searchsorted(start, cuts)
    begins = np.concatenate([[0], ends[:-1]])
    if len(h) >= words:
        full = h[: len(h) - words + 1] * _M[0]
        for k in range(1, words):
            full = (full ^ (full >> np.uint64(31))) * _M[k % 5] + h[k : len(h) - words + 1 + k]
        full = _mix(full)
    out = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a >= words:
            own = np.sort(full[a : b - words + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            own = np.full(1, b - a, np.uint64) * _M[2] + np.uint64(1)
            for k in range(a, b):
                own = ((own ^ (own >> np.uint64(31))) * _M[3]) + h[k : k + 1]
            out.append(_mix(own))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def links(a: int, b: int, both: int, threshold: int = THRESHOLD) -> bool:
    """Whether sets of ``a`` and ``b`` with ``both`` in common link."""
    return both > 0 and 100 * both >= threshold * (a + b - both)


def prefix_size(n: int, threshold: int = THRESHOLD) -> int:
    """Elements of a set of ``n`` of which one is common to any set it links to."""
    return n + (-n * threshold) // 100 + 1 if n else 0


# ---------------------------------------------------------------- the trie


class Trie:
    """Sets in one global order, with common beginnings stored once.

    A node is a run of elements that the same sets share: it has its parent, the
    depths where the run begins and ends, the run's place in ``run``, and the least
    and greatest size of the sets below and their number.
    """

    def __init__(self, sets: list[np.ndarray], threshold: int = THRESHOLD):
        self.threshold = threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        self.values, inverse, n = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((np.arange(len(n)), -n))] = np.arange(len(n))
        self.rank = rank
        ranks = rank[inverse].astype(">u4")
        ends = np.cumsum(self.size)
        self.sets = [np.sort(ranks[e - s : e]) for e, s in zip(ends.tolist(), self.size.tolist(), strict=True)]
        self.universe = len(n)
        self._build(sorted(range(len(sets)), key=lambda i: self.sets[i].tobytes()))

    def _build(self, order: list[int]) -> None:
        depth, parent, of, here = [0], [-1], [order[0]], [-1]  # the root; of: a set below, here: the set that ends
        stack = [0]
        last = self.sets[order[0]][:0]
        for i in order:
            own = self.sets[i]
            m = min(len(own), len(last))
            differ = np.flatnonzero(own[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            below = -1
            while depth[stack[-1]] > common:
                below = stack.pop()
                if depth[stack[-1]] < common:  # the run is cut where the two part
                    depth.append(common)
                    parent.append(-1)
                    of.append(i)
                    here.append(-1)
                    stack.append(len(depth) - 1)
                parent[below] = stack[-1]
            depth.append(len(own))
            parent.append(-1)
            of.append(i)
            here.append(i)
            stack.append(len(depth) - 1)
            last = own
        while len(stack) > 1:
            below = stack.pop()
            parent[below] = stack[-1]
        self.end, self.parent, self.set_at = np.array(depth), np.array(parent), np.array(here)
        nodes = len(depth)
        self.begin = np.where(self.parent >= 0, self.end[self.parent], 0)
        self.node_of = np.zeros(len(order), np.int64)
        self.node_of[self.set_at[self.set_at >= 0]] = np.flatnonzero(self.set_at >= 0)
        self.kids = np.argsort(self.parent, kind="stable")
        self.first = np.searchsorted(self.parent[self.kids], np.arange(-1, nodes + 1))
        size = self.end - self.begin
        self.run_start = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.run = np.concatenate([self.sets[k][b:e] for k, b, e in zip(of, self.begin.tolist(), depth, strict=True)]).astype(np.int64)
        self.last = np.where(size > 0, self.run[np.minimum(self.run_start + size - 1, len(self.run) - 1)], -1)
        # least and greatest size of the sets below, and their number
        self.least = np.where(self.set_at >= 0, self.end, 1 << 60)
        self.most = np.where(self.set_at >= 0, self.end, 0)
        self.alive = (self.set_at >= 0).astype(np.int64)
        levels = []
        todo = np.zeros(1, np.int64)
        while len(todo):
            levels.append(todo)
            todo = self._below(todo)
        for level in reversed(levels[1:]):
            np.minimum.at(self.least, self.parent[level], self.least[level])
            np.maximum.at(self.most, self.parent[level], self.most[level])
            np.add.at(self.alive, self.parent[level], self.alive[level])
        self.here = np.ones(len(order), bool)
        self.mark = np.zeros(self.universe + 1, np.int64)
        self.before = np.zeros(nodes, np.int64)

    def _below(self, nodes: np.ndarray) -> np.ndarray:
        a, b = self.first[nodes + 1], self.first[nodes + 2]
        n = b - a
        if not n.sum():
            return np.zeros(0, np.int64)
        return self.kids[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def drop(self, i: int) -> None:
        """The set ``i`` isn't found any more."""
        if self.here[i]:
            self.here[i] = False
            node = int(self.node_of[i])
            while node >= 0:
                self.alive[node] -= 1
                node = int(self.parent[node])

    def ranks_of(self, other: np.ndarray) -> np.ndarray:
        """The sorted ranks of those elements of a set that the trie has."""
        at = np.minimum(np.searchsorted(self.values, other), len(self.values) - 1)
        return np.sort(self.rank[at[self.values[at] == other]])

    def find(self, probe: np.ndarray, n: int) -> np.ndarray:
        """The sets that are still there and link with one of ``n`` elements, of which
        the trie has those with the sorted ranks ``probe``."""
        t = self.threshold
        mark, before = self.mark, self.before
        mark[probe] = 1
        before[0] = 0
        hits: list[np.ndarray] = []
        todo = self._below(np.zeros(1, np.int64))
        while len(todo):
            todo = todo[self.alive[todo] > 0]
            if not len(todo):
                break
            size = self.end[todo] - self.begin[todo]
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            places = np.repeat(self.run_start[todo] - starts, size) + np.arange(size.sum())
            both = np.add.reduceat(mark[self.run[places]], starts) + before[self.parent[todo]]
            before[todo] = both
            # A set of m elements below can have m - depth more in common, and no
            # more than the probe has left; of the sizes there are, the best is
            # the one that uses up both.
            depth, rest = self.end[todo], len(probe) - np.searchsorted(probe, self.last[todo], side="right")
            m = np.clip(depth + rest, self.least[todo], self.most[todo])
            could = (100 + t) * (both + np.minimum(m - depth, rest)) >= t * (n + m)
            todo, both = todo[could], both[could]
            ends = self.set_at[todo]
            at = np.flatnonzero(ends >= 0)
            if len(at):
                own, b = ends[at], both[at]
                hits.append(own[self.here[own] & (b > 0) & (100 * b >= t * (n + self.size[own] - b))])
            todo = self._below(todo)
        mark[probe] = 0
        return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def forest(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect: pairs of places."""
    full = [i for i, s in enumerate(sets) if len(s)]
    if len(full) < len(sets):  # empty sets link with nothing
        return [(full[a], full[b]) for a, b in forest([sets[i] for i in full], threshold)]
    seen: dict[bytes, int] = {}
    same = [(seen[k], i) for i, k in enumerate(s.tobytes() for s in sets) if seen.setdefault(k, i) != i]
    if same:  # equal sets link; one of each goes on
        only = list(seen.values())
        return [*same, *((only[a], only[b]) for a, b in forest([sets[i] for i in only], threshold))]
    if len(sets) < 2:
        return []
    if len(sets) == 2:
        a, b = sets
        return [(0, 1)] if links(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), threshold) else []
    out: list[tuple[int, int]] = []
    trie = Trie(sets, threshold)
    for seed in range(len(sets)):
        if not trie.here[seed]:
            continue
        trie.drop(seed)
        queue = [seed]
        while queue:
            i = queue.pop()
            for j in trie.find(trie.sets[i].astype(np.int64), len(sets[i])).tolist():
                trie.drop(j)
                out.append((i, j))
                queue.append(j)
    return out


def across(left: list[np.ndarray], right: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links of sets in ``left`` with distinct ones in ``right``, which connect all that
    such links connect: pairs of places."""
    if not left or not right:
        return []
    trie = Trie(right, threshold)
    found = [(i, len(left) + j) for i, x in enumerate(left) for j in trie.find(trie.ranks_of(x), len(x)).tolist()]
    return [(i, j - len(left)) for i, j in _tree(found, len(left) + len(right))]


def _tree(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    top = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            top[x] = y
            out.append((a, b))
    return out


# ---------------------------------------------------------------- the stages


def named_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, name) of each document: its set's size and 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("name", pa.binary())])
        for batch, texts in slices(batches):
            found = shingle_sets(texts, words)
            yield record_batch({"doc_id": batch.column(0), "n": [len(s) for s in found], "name": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, name binary")


def bucket_count(docs: DataFrame) -> int:
    """Buckets of shingles: one for each 8 MB of input, and one for each partition
    of a shuffle at least."""
    return min(1 << 30, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) >> 23))


_PACKED = "key long, kind int, flush long, a binary, b binary, c binary, d binary"
_PREFIX = "key long, n long, least long, a binary, b binary, c binary, d binary"
#: Stands for the place of a set where several sets of a flush have a shingle.
_SEVERAL = np.uint16(0xFFFF)


def _planes(sorted_: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as their differences, all first bytes first."""
    steps = np.diff(sorted_, prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _joined(parts, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _flush_rows(flush: int, sets: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[tuple]:
    """A flush's own row (kind 1; a: id and size of its sets, b: the shingles that
    several have, c: how many, d: which) and one for each bucket (kind 0; a: shingles,
    b: the set that has each, c: how many have it where several do)."""
    h = np.concatenate([s for _, s in sets])
    at = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for _, s in sets])
    g = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    del h
    by = np.argsort(g, kind="stable")
    g, at = g[by], at[by]
    del by
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    n = np.diff(np.append(first, len(g)))
    several = n > 1
    who = np.where(several, _SEVERAL, at[first])
    g, members = g[first], at[np.repeat(several, n)]
    del at
    table = np.array([(d, len(s)) for d, s in sets], np.int64)
    yield -1 - flush, 1, flush, table.tobytes(), g[several].tobytes(), n[several].astype(np.uint32).tobytes(), members.tobytes()
    cuts = np.searchsorted(g, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[k], cuts[k + 1])
        yield k, 0, flush, _planes(g[own].astype(np.uint32)), who[own].tobytes(), n[own][several[own]].astype(np.uint32).tobytes(), b""


def shingle_rows(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """The rows of all flushes (``_flush_rows``).  A task sends equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("flush", pa.int64()), *((c, pa.binary()) for c in "abcd")])
        sent: set[int] = set()
        sets: list[tuple[int, np.ndarray]] = []
        flush = TaskContext.get().partitionId() << 32
        held = 0

        def packed():
            rows: list[tuple] = []
            size = 0
            for row in _flush_rows(flush, sets, buckets):
                rows.append(row)
                size += sum(map(len, row[3:]))
                if size > 4 << 20:
                    yield record_batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)
                    rows, size = [], 0
            yield record_batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)

        for batch, texts in slices(batches):
            for doc, own in zip(batch.column(0).to_pylist(), shingle_sets(texts, words), strict=True):
                name = xxhash.xxh3_64_intdigest(own.tobytes())
                if doc is None or not len(own) or name in sent:
                    continue
                sent.add(name)
                sets.append((doc, own))
                held += len(own)
                if held > FLUSH or len(sets) >= FLUSH_SETS:
                    yield from packed()
                    sets.clear()
                    flush, held = flush + 1, 0
            if len(sent) > 1 << 20:
                sent.clear()
        if sets:
            yield from packed()

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


def shared_shingles(rows: DataFrame) -> DataFrame:
    """The flushes' own rows, and for each flush and bucket (kind 2) the shingles that
    several sets have: a: shingles, b: the flush's set that has each, c: the number of
    sets that have each, d: the bucket.  Equal sets of different tasks count each."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return group
        parts = [_unplaned(x) for x in group["a"]]
        low, row = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts])
        who = _joined(group["b"], np.uint16)
        n = np.ones(len(low), np.int64)
        n[who == _SEVERAL] = _joined(group["c"], np.uint32)
        by = np.argsort(low, kind="stable")
        low, row, who, n = low[by], row[by], who[by], n[by]
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        total = np.add.reduceat(n, first)
        total = np.repeat(total, np.diff(np.append(first, len(low))))
        by = np.flatnonzero(total > 1)
        by = by[np.argsort(row[by], kind="stable")]
        low, row, who, total = low[by], row[by], who[by], np.minimum(total[by], 0xFFFFFFFF).astype(np.uint32)
        cuts = np.searchsorted(row, np.arange(len(parts) + 1))
        out = []
        for i, flush in enumerate(group["flush"].tolist()):
            own = slice(cuts[i], cuts[i + 1])
            if cuts[i + 1] > cuts[i]:
                out.append((-1 - flush, 2, flush, low[own].tobytes(), who[own].tobytes(), total[own].tobytes(), np.int64(key[0]).tobytes()))
        return _frame(out, _PACKED)

    return rows.groupBy("key").applyInPandas(run, _PACKED)


def prefixes(shared: DataFrame, threshold: int = THRESHOLD, hot_sets: int = HOT_SETS) -> DataFrame:
    """Elements of prefixes that other sets have too: the order is by the number of sets
    and then by hash, so elements of one set alone come first and fill most prefixes
    whole.  Rows by flush and bucket (n is 0; a: shingles, b: ids, c: sizes, d: whether
    the element is in the shorter prefix, one of whose elements is common to any set
    that it links to and that is at least as large), and by flush and shingle that more
    than ``hot_sets`` sets have (n: how many, least: the least id, a: all ids)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, told = group[group["kind"] == 1].iloc[0], group[group["kind"] == 2]
        if not len(told):
            return _frame([], _PREFIX)
        docs = np.frombuffer(own["a"], np.int64).reshape(-1, 2)
        parts = [np.frombuffer(x, np.uint32) for x in told["a"]]
        bucket = np.repeat(_joined(told["d"], np.int64).astype(np.uint64), [len(x) for x in parts])
        g = bucket << np.uint64(32) | np.concatenate(parts)
        who, n = _joined(told["b"], np.uint16), _joined(told["c"], np.uint32)
        # those that several sets of the flush have, once for each
        repeated, count = np.frombuffer(own["b"], np.uint64), np.frombuffer(own["c"], np.uint32).astype(np.int64)
        members = np.frombuffer(own["d"], np.uint16)
        several = who == _SEVERAL
        size = count[np.searchsorted(repeated, g[several])]
        begin = (np.cumsum(count) - count)[np.searchsorted(repeated, g[several])]
        places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        at = np.concatenate([who[~several], members[places]])
        g, n = np.concatenate([g[~several], np.repeat(g[several], size)]), np.concatenate([n[~several], np.repeat(n[several], size)])
        by = np.lexsort((g, n, at))
        g, n, at = g[by], n[by], at[by]
        size = docs[at, 1]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        rank = np.arange(len(at)) - np.repeat(first, count) + size - np.repeat(count, count)
        keep = rank < size + (-size * threshold) // 100 + 1
        short = rank < size - -(-2 * threshold * size // (100 + threshold)) + 1
        g, n, doc, size, short = g[keep], n[keep], docs[at[keep], 0], size[keep], short[keep]
        by = np.argsort(g, kind="stable")
        g, n, doc, size, short = g[by], n[by], doc[by], size[by], short[by]
        out = []
        hot = n > hot_sets
        for x in np.unique(g[hot]).tolist():
            a, b = np.searchsorted(g, np.array([x, x + 1], np.uint64))
            out.append((x, int(n[a]), int(doc[a:b].min()), doc[a:b].tobytes(), b"", b"", b""))
        g, doc, size, short = g[~hot], doc[~hot], size[~hot], short[~hot]
        bucket = (g >> np.uint64(32)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(g)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append((int(bucket[a]), 0, 0, g[a:b].astype(np.uint32).tobytes(), doc[a:b].tobytes(), size[a:b].astype(np.uint32).tobytes(), short[a:b].tobytes()))
        return _frame(out, _PREFIX)

    return shared.groupBy("key").applyInPandas(run, _PREFIX)


def leaders(found: DataFrame, threshold: int = THRESHOLD, hot_sets: int = HOT_SETS) -> DataFrame:
    """(leader, doc_id) of documents that share an element of their prefixes with
    another that can link to them by its size; the leader is the least of them."""

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        h, doc, size, short = (_joined(group[c], k) for c, k in zip("abcd", (np.uint32, np.int64, np.uint32, bool), strict=True))
        size = size.astype(np.int64)
        by = np.lexsort((doc, ~short, size, h))
        h, doc, size, short = h[by], doc[by], size[by], short[by]
        # the next larger set, and the last one before that has the element in its
        # shorter prefix
        after = np.concatenate([(h[1:] == h[:-1]) & (100 * size[:-1] >= threshold * size[1:]), [False]])
        last = np.maximum.accumulate(np.where(short, np.arange(len(h)), -1))
        last = np.concatenate([[-1], last[:-1]])
        before = (last >= 0) & (h[np.maximum(last, 0)] == h) & (100 * size[np.maximum(last, 0)] >= threshold * size)
        useful = np.flatnonzero(short & after | before)
        h, doc = h[useful], doc[useful]
        by = np.lexsort((doc, h))
        h, doc = h[by], doc[by]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        lead = np.repeat(doc[first], np.diff(np.append(first, len(h))))
        pairs = np.unique(np.stack([lead, doc], axis=1), axis=0)
        return pd.DataFrame({"leader": pairs[:, 0], "doc_id": pairs[:, 1]})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("leader", pa.int64()), ("doc_id", pa.int64())])
        for batch in batches:
            for lead, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(docs, np.int64)
                yield record_batch({"leader": pa.array(np.full(len(ids), lead)), "doc_id": pa.array(ids)}, schema)

    usual = found.filter("n = 0").groupBy("key").applyInPandas(assign, "leader long, doc_id long")
    hot = found.filter("n > 0")
    shares = F.ceil(F.col("n") / F.lit(hot_sets)).cast("int")
    tops = hot.groupBy("key", "n").agg(F.min("least").alias("leader")).withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = hot.select("key", "a", F.pmod(F.xxhash64("a"), shares).cast("int").alias("share"))
    return usual.union(dealt.join(tops.select("key", "share", "leader"), ["key", "share"]).select("leader", "a").mapInArrow(unpack, "leader long, doc_id long")).distinct()


def sets_of(docs: DataFrame, chosen: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, set) of the chosen documents (doc_id): picked by a broadcast list of
    ids while there are no more than ``BROADCAST_IDS``, else by a join."""
    schema = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch], picked=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if picked is not None:
                own = batch.column(0).fill_null(-(1 << 63)).to_numpy()
                at = np.minimum(np.searchsorted(picked, own), len(picked) - 1)
                batch = batch.filter(pa.array((picked[at] == own) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
            for part, texts in slices([batch]):
                yield record_batch({"doc_id": part.column(0), "set": [s.tobytes() for s in shingle_sets(texts, words)]}, schema)

    docs = docs.select("doc_id", "text")
    n = chosen.count()
    if n == 0:
        return docs.limit(0).mapInArrow(read, "doc_id long, set binary")
    if n <= BROADCAST_IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(chosen.toPandas()["doc_id"].to_numpy(np.int64)))
        return docs.mapInArrow(lambda batches: read(batches, shared.value), "doc_id long, set binary")
    return docs.join(chosen, "doc_id", "left_semi").mapInArrow(read, "doc_id long, set binary")


def with_rep(known: DataFrame) -> DataFrame:
    """``known`` (doc_id, n, name) with rep: the least document that has the same set.
    Names of very many rows are joined by a broadcast of ``HOT_NAMES`` names at most."""
    several = written(known.groupBy("name").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "set-names")
    bound = max(1000, known.count() // HOT_NAMES)
    hot = F.broadcast(several.filter(F.col("rows") > bound).select("name", "rep"))
    rest = known.join(hot.select("name"), "name", "left_anti").join(several.filter(F.col("rows") <= bound).select("name", "rep"), "name", "left")
    columns = ["doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")]
    return known.join(hot, "name").select(*columns).union(rest.select(*columns))


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _pairs(ids: list, other: list, found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [ids[x] for x, _ in found], "b": [other[y] for _, y in found]}, columns=["a", "b"], dtype="int64")


def _shares(shingles, sets):
    """Blocks that a group's sets are dealt to."""
    return F.greatest(F.lit(1), F.ceil(shingles / F.lit(GROUP_SHINGLES)), F.ceil(sets / F.lit(GROUP_SETS))).cast("int")


def large_group_links(large: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links of groups (leader, doc_id, n, blocks) that are cut into blocks."""
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = large.join(sets, "doc_id").withColumn("block", block)
    pivots = members.filter("doc_id = leader").withColumn("block", every)

    def with_pivot(group: pd.DataFrame) -> pd.DataFrame:
        pivot, own = group["doc_id"] == group["leader"], group[group["doc_id"] != group["leader"]]
        one = np.frombuffer(group["set"][pivot].iloc[0], np.uint64)
        both = [len(np.intersect1d(one, x, assume_unique=True)) for x in _sets(own["set"])]
        linked = [links(len(one), n, k, threshold) for n, k in zip(own["n"].tolist(), both, strict=True)]
        return own[["leader", "doc_id", "n", "blocks"]].assign(linked=linked)

    first = members.filter("doc_id <> leader").union(pivots).groupBy("leader", "block").applyInPandas(with_pivot, "leader long, doc_id long, n long, blocks int, linked boolean")
    first = written(first, "pivot-links")
    left = first.filter("NOT linked")
    parts = left.groupBy("leader").agg(_shares(F.sum("n"), F.count(F.lit(1))).alias("parts"))
    # what doesn't link with the leader meets every block of the group
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")
    both = first.join(parts, "leader").withColumn("side", F.explode(F.when(F.col("linked"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    both = both.withColumn("block", F.explode(F.when(F.col("side") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    both = both.withColumn("part", F.explode(F.when(F.col("side") == 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part)))).join(sets, "doc_id")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        return _pairs(a["doc_id"].tolist(), b["doc_id"].tolist(), across(_sets(a["set"]), _sets(b["set"]), threshold))

    rest = both.select("leader", "part", "block", "side", "doc_id", "set").groupBy("leader", "part", "block").applyInPandas(meet, "a long, b long")
    return first.filter("linked").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).union(rest)


def component_links(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, name) of every document; (doc_id, n, rep) of those with a set; and
    (a, b): pairs of documents, one for each distinct set, whose links connect all that
    links connect."""
    named = written(named_sets(docs, words), "shingle-sets")
    known = written(with_rep(named.filter("doc_id IS NOT NULL AND name IS NOT NULL")), "set-reps")
    # the least document with the same set stands for each
    rep = known.groupBy("doc_id", "rep").agg(F.max("n").alias("n"))
    found = written(prefixes(shared_shingles(shingle_rows(docs, bucket_count(docs), words)), threshold, HOT_SETS), "prefixes")
    groups = leaders(found, threshold, HOT_SETS)
    groups = groups.join(rep, "doc_id").select("leader", F.col("rep").alias("doc_id"), "n").join(rep.select(F.col("doc_id").alias("leader"), F.col("rep").alias("top")), "leader")
    groups = written(groups.groupBy(F.col("top").alias("leader"), "doc_id").agg(F.max("n").alias("n")), "shingle-groups")
    dropped(found)
    # a group of one has nothing to compare
    sized = groups.groupBy("leader").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    cut = written(groups.join(sized.select("leader", _shares(F.col("total"), F.col("members")).alias("blocks")), "leader").select("leader", "doc_id", "n", "blocks"), "shingle-cut")
    dropped(groups)
    sets = written(sets_of(docs, cut.select("doc_id").distinct(), words), "shingle-set-values")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["doc_id"].tolist()
        return _pairs(ids, ids, forest(_sets(group["set"]), threshold))

    linked = cut.filter("blocks = 1").join(sets, "doc_id").groupBy("leader").applyInPandas(link, "a long, b long")
    if not cut.filter("blocks > 1").isEmpty():
        linked = linked.union(large_group_links(cut.filter("blocks > 1"), sets, threshold))
    linked = written(linked.filter("a <> b").distinct(), "shingle-links")
    dropped(cut, sets)
    return named, known, linked


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node it reaches.

    Each round gives a node the least root that a neighbour has, then that root's
    root; rounds grow with the logarithm of the longest path.
    """
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # the root's own new root, and what this node learned for its old root
        lower = step.filter(F.col("root") < F.col("old")).groupBy(F.col("old").alias("node")).agg(F.min("root").alias("hint"))
        step = step.join(lower, "node", "left").select("node", "old", F.least("root", F.coalesce("hint", "root")).alias("root"))
        step = written(step, "roots-step")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = written(step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("top", "root")).alias("root")), "roots")
        dropped(roots, step)
        if new.filter(F.col("root") < F.col("old")).isEmpty():
            dropped(edges)
            return new.select("node", "root")
        roots = new


def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named, known, edges = component_links(docs, words, threshold)
    # rows of one document, and documents of one set, are together; so are those
    # whose sets link
    own = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps"))
    tops = components(edges.union(own.filter(F.size("reps") > 1).select("a", F.explode("reps").alias("b")).filter("a < b")))
    ids = own.join(tops, own.a == tops.node, "left").select("doc_id", F.coalesce("root", "a").alias("component_id"))
    return named.join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents"))
