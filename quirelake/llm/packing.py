"""Lexical retrieval packing of documents into training sequences.

Each sequence has a seed document; an inverted index of its shard returns the
unused documents nearest to it by BM25, which fill the sequence one after the
other.  Where a seed has no unused neighbour, the next document is the seed.  The last one is cut where the sequence is full, and its remainder seeds
the next.  So only a partition's last sequence needs padding.

1. Texts are encoded once.  A table in the shared folder keeps the ids in two
   bytes each, with a key that is alike for documents with common passages.
   The same pass counts, for each id, the documents that hold it: BM25's terms are
   token ids, so these corpus-wide counts have the vocabulary's size.
2. Documents are dealt by ranges of the key, with a hash behind it that splits
   groups of any size, and sorted.  A task reads its range as a stream, in shards
   of ``SHARD_TOKENS`` that it indexes one at a time; an open sequence is carried
   over into the next shard.

A document's ids are those of its text and one ``END`` behind them.  They are cut
freely; every id is in exactly one piece.

Nulls, empty and odd rows: a null or empty text has ``END`` alone; a very long text
is encoded whole, alone in its batch, and cut into as many sequences as it fills; a
null id is carried; repeated rows are packed as documents of their own; ties in BM25
go to the document that comes first in the shard; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hf_tokenizer, record_batch, table, text_slices, written

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 2048
END = 1
#: BM25's parameters.
K1, B = 1.2, 0.75
#: Neighbours that are queued at once; when they are used up, more are sought.
NEIGHBOURS = 64
#: Bytes of text whose stretches are told apart at once (a worker's memory grows by 16
#: times as much).
BATCH_BYTES = 4 << 20
#: Tokens that one index holds.
SHARD_TOKENS = 1 << 20

# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the
# others for the code points from 256 on, in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}  # the others

#: White space other than single spaces and line ends between other characters, and
#: what versions of Unicode may differ on or what may be a special token.
_ODD_SPACE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HARD = r"[^\x00-\x{24f}]|<\|"
_HARD_ROW = r"[^\x00-\x{24f}]|<\||[\x1c-\x1f\x{85}\x{a0}]"
# Fixed value: the pieces of a byte-level pre-tokeniser.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _merges(tokenizer):
    """A faster encoder by the tokenizer's own vocabulary, where that is a byte-level
    one whose ids, but for those of single bytes, are in the order of its merges; else
    None."""
    import tiktoken

    parts = json.loads(tokenizer.to_str())
    model, pre = parts["model"], parts.get("pre_tokenizer") or {}
    if parts.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get("".join(p)) for p in pairs]
    bytes_of = {chr(b): b for b in _PRINTED} | {c: b for b, c in _BYTE_CHARS.items()}
    single = [t for t in model["vocab"] if t in bytes_of]
    if None in made or any(x >= y for x, y in zip(made, made[1:], strict=False)) or len(single) < 256 or max(map(model["vocab"].get, single)) >= min(made, default=256):
        return None
    ranks = {bytes(map(bytes_of.__getitem__, t)): model["vocab"][t] for t in [*single, *map("".join, pairs)]}
    return tiktoken.Encoding("merges", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes whole texts, a batch's at once.

    The pre-tokeniser always begins a new piece at a space, and at a line end, between
    two characters that aren't white space, so such stretches, with what is before
    them, are encoded independently.  Arrow tells a batch's stretches apart, and each
    distinct one is encoded once.  Texts with other white space are encoded whole.
    """

    def __init__(self, tokenizer: str):
        self.tokenizer = hf_tokenizer(tokenizer)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u4") if size > 1 << 16 else np.dtype("<u2")
        self.merges = _merges(self.tokenizer)
        if self.merges is not None:
            self.opens = np.zeros(size, bool)  # ids that begin with a space or line end
            self.opens[[i for t, i in self.merges._mergeable_ranks.items() if t[:1] in (b" ", b"\n")]] = True

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, by the tokenizer."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def stretches(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct stretches in one array, and where each begins and the
        last one ends.  One that begins with a line end is behind it, others are behind
        a space; an empty one has no ids."""
        hard = pc.match_substring_regex(words, _HARD).to_numpy(zero_copy_only=False)
        easy = np.flatnonzero(~hard & (pc.binary_length(words).to_numpy() > 0))
        n = np.zeros(len(words), np.int64)
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(easy)], words.take(pa.array(easy))), pa.scalar(" ", words.type))[0].as_py() if len(easy) else ""
        ids = self.merges.encode_to_numpy("x " * bool(len(easy)) + text.replace(" \n", "\n") if not text.startswith("\n") else "x" + text.replace(" \n", "\n"))
        at = np.flatnonzero(self.opens[ids])
        if len(at) != len(easy):
            raise ValueError("stretches and pieces differ")
        n[easy] = np.diff(np.append(at, len(ids)))
        ids = ids[at[0] :] if len(at) else ids[:0]
        if hard.any():
            parts = np.split(ids, np.cumsum(n[easy])[:-1]) if len(easy) else []
            every: list = [ids[:0]] * len(words)
            for i, x in zip(easy.tolist(), parts, strict=True):
                every[i] = x
            for i in np.flatnonzero(hard).tolist():
                word = words[i].as_py()
                every[i] = self.encode(word if word[0] == "\n" else " " + word)
                n[i] = len(every[i])
            ids = np.concatenate(every)
        return ids, np.concatenate([[0], np.cumsum(n)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (large strings without nulls) in one array, and where
        each text's ids begin and the last one's end."""
        if self.merges is None:
            found = [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        # "x" stands for x behind a space and "\nx" for x behind a line end; the first
        # stretch of a text is what is encoded behind a line end, without that
        split = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
        counts = np.diff(split.offsets.to_numpy())
        told = split.flatten().dictionary_encode()
        at = told.indices.to_numpy().astype(np.int64)
        first = np.cumsum(counts) - counts
        lead, own = np.unique(at[first], return_inverse=True)
        words = told.dictionary
        leading = words.take(pa.array(lead))
        line, none = (pa.scalar(x, words.type) for x in ("\n", ""))
        begins = pc.if_else(pc.equal(leading, none), none, pc.binary_join_element_wise(line, leading, none))
        flat, bounds = self.stretches(pa.concat_arrays([words, begins]))
        start, n = bounds[:-1].copy(), np.diff(bounds)
        skip = (n > 0) & (np.arange(len(n)) >= len(words))
        start[skip] += 1
        n[skip] -= 1
        at[first] = own + len(words)
        size = n[at]
        stop = np.cumsum(size)
        ids = flat[np.repeat(start[at] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(self.kind)
        bounds = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):  # they have no ids so far
            hard = pc.match_substring_regex(texts, _HARD_ROW).to_numpy(zero_copy_only=False)
            pieces = np.split(ids, bounds[1:-1])
            for i in rows.tolist():
                text = texts[i].as_py()
                pieces[i] = (self.encode(text) if hard[i] else self.merges.encode_to_numpy(text)).astype(self.kind)
            ids = np.concatenate(pieces)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        return ids, bounds


_encoders: dict[str, Encoder] = {}


def keys_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Alike for documents with common passages: the least hash of four ids in a row
    of each document; of fewer, the first id."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.int64)
    some = n > 0
    out[some] = ids[bounds[:-1][some]]
    full = np.flatnonzero(n >= 4)
    if len(full):
        x = np.concatenate([ids, np.zeros(3, ids.dtype)]).astype(np.uint32)
        h = x[: len(ids)].copy()
        for k in range(1, 4):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[k : len(ids) + k]
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = h ^ (h >> np.uint32(16))
        for k in range(1, 4):  # those that reach into the next document
            h[bounds[1:][full] - k] = 0xFFFFFFFF
        out[full] = np.minimum.reduceat(h, np.stack([bounds[full], bounds[full + 1] - 3], axis=1).ravel())[::2]
    return out


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows of two kinds: of a document (doc_id, ids without ``END``, key, tie), and
    of a task (counts: by id, its documents that hold it; ids: two numbers, its
    documents and their ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.large_binary()), ("key", pa.int64()), ("tie", pa.int64()), ("counts", pa.large_binary())])
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        own = _encoders[tokenizer]
        counts = np.zeros(own.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        place = np.zeros(len(counts), np.int64)
        n = size = 0
        for batch, texts in text_slices(batches, most=BATCH_BYTES):
            ids, bounds = own.encode_all(texts)
            for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                x, here = ids[a:b], np.arange(a, b)
                place[x] = here  # of an id's places one stays, so each counts once
                counts[x[place[x] == here]] += 1
            n, size = n + batch.num_rows, size + len(ids)
            names = batch.column(0).to_pylist()
            packed = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer((bounds * own.kind.itemsize).astype(np.int64)), pa.py_buffer(ids)])
            yield record_batch({"doc_id": names, "ids": packed, "key": keys_of(ids, bounds), "tie": [xxhash.xxh3_64_intdigest(str(d)) >> 1 for d in names], "counts": [None] * len(names)}, schema)
        if n:
            yield record_batch({"doc_id": [None], "ids": [np.array([n, size], np.int64).tobytes()], "key": [None], "tie": [None], "counts": [counts.tobytes()]}, schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary, key long, tie long, counts binary")


def _statistics(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """By id, the documents that hold it; documents; their ids in all."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = None, np.zeros(2, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(x, np.int64)
                total = found.copy() if total is None else total + found
                both += np.frombuffer(y, np.int64)
        if total is not None:
            yield record_batch({"counts": [total.tobytes()], "ids": [both.tobytes()]}, pa.schema([("counts", pa.binary()), ("ids", pa.binary())]))

    # level by level, so that no task adds up many and the driver gets few of them
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.filter("counts IS NOT NULL").select("counts", "ids").mapInArrow(add, "counts binary, ids binary")
    for n in (parts, math.isqrt(parts)) if parts > 64 else (math.isqrt(parts),):
        sums = sums.repartition(n).mapInArrow(add, "counts binary, ids binary")
    sums = sums.collect()
    if not sums:
        return np.zeros(0, np.int64), 0, 0
    both = sum(np.frombuffer(r.ids, np.int64) for r in sums)
    return sum(np.frombuffer(r.counts, np.int64) for r in sums), int(both[0]), int(both[1])


class Index:
    """An inverted index of a shard's documents with BM25's weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.idf, self.docs = idf, docs
        found = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [x[0] for x in found]
        self.tf = [x[1] for x in found]
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        term = np.concatenate(self.terms) if docs else np.zeros(0, np.int64)
        tf = np.concatenate(self.tf).astype(np.float64) if docs else np.zeros(0)
        size = np.array([len(d) for d in docs], np.float64)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1e-9))) * idf[term]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all the seed's terms."""
        terms = self.terms[seed].astype(np.int64)
        a, b = self.at[terms], self.at[terms + 1]
        n = b - a
        if not n.sum():
            return np.zeros(len(self.docs))
        places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.doc[places], self.weight[places], len(self.docs))


class Packer:
    """Packs shards one after the other; ``rows`` are (place in shard, start, length,
    sequence, offset)."""

    def __init__(self, length: int):
        self.length, self.sequence, self.filled = length, 0, 0

    def pack(self, sizes: list[int], index: Index) -> list[tuple[int, int, int, int, int]]:
        rows = []
        unused = np.ones(len(sizes), bool)
        following = 0  # all documents before this one are used
        queue: list[int] = []
        seed = -1
        for _ in range(len(sizes)):
            while queue and not unused[queue[-1]]:
                queue.pop()
            if queue:
                doc = queue.pop()
            else:
                while not unused[following]:
                    following += 1
                doc = seed = following
            unused[doc] = False
            start = 0
            while start < sizes[doc]:
                if self.filled == 0:
                    seed, queue = doc, []  # what begins a sequence is its seed
                n = min(sizes[doc] - start, self.length - self.filled)
                rows.append((doc, start, n, self.sequence, self.filled))
                start += n
                self.filled += n
                if self.filled == self.length:
                    self.sequence, self.filled = self.sequence + 1, 0
            if self.filled and not queue and unused.any():
                near = np.where(unused, index.scores(seed), -1.0)
                best = np.arange(len(near))
                if len(near) > NEIGHBOURS:  # with all that tie with the last one
                    best = np.flatnonzero(near >= np.partition(near, -NEIGHBOURS)[-NEIGHBOURS])
                best = best[np.argsort(-near[best], kind="stable")[:NEIGHBOURS]]
                queue = best[near[best] > 0][::-1].tolist()
        return rows


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids themselves."""
    spark = docs.sparkSession
    rows = written(encoded(docs, tokenizer), "encoded", "zstd")
    counts, n, size = _statistics(rows)
    if not n:
        counts = np.zeros(1, np.int64)
    # the end's id is every document's, so it says nothing
    idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
    shared = spark.sparkContext.broadcast((idf, size / max(n, 1)))
    wide = len(idf) > 1 << 16
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        packer = Packer(length)
        first = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[np.ndarray] = []  # without the end's id, which is no term

        def shard():
            full = [np.append(x, np.array([end], x.dtype)) for x in ids]
            found = packer.pack([len(x) for x in full], Index(ids, idf, mean))
            pieces = [full[d][s : s + k].astype("<u4") for d, s, k, _, _ in found]
            out = {
                "doc_id": [names[r[0]] for r in found],
                "start": [r[1] for r in found],
                "length": [r[2] for r in found],
                "ids_crc32": [zlib.crc32(p.tobytes()) for p in pieces],
                "doc_tokens": [len(full[r[0]]) for r in found],
                "sequence_id": [first + r[3] for r in found],
                "offset": [r[4] for r in found],
            }
            if with_ids:
                out["ids"] = pieces
            names.clear()
            ids.clear()
            return record_batch(out, pa.schema(fields))

        held = 0
        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                ids.append(np.frombuffer(x.as_py(), "<u4" if wide else "<u2"))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield shard()
                    held = 0
        if ids:
            yield shard()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter("counts IS NULL").select("doc_id", "ids", "key", "tie").repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie", "doc_id", F.xxhash64("ids")).select("doc_id", "ids")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, packed."""
    return pack(table(spark, sf_dir, "documents"))
