"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over each text's bytes cuts it into chunks whose borders depend
on the content around them alone, so copied passages give the same chunks
wherever they stand.  A worker encodes a chunk once and keeps its ids.

A border may split a word, or what the tokenizer would join, so joins are repaired.
A window of ``WINDOW`` words on either side of the join is encoded anew by the
tokenizer.  Its ids must begin as the left chunk's do there and end as the right
one's do: the outer words' ids are compared.  If they agree, the window's ids take the
place of both chunks' ids of these words; if not, the window is widened twofold until
they do, and a text whose windows would overlap is encoded whole.  Chunks of
too few words for two windows are one with the next.

A chunk that isn't known is encoded by its words, which a worker remembers too, where
the tokenizer drops white space, as this one does: the tokenizer alone takes longer than
the rest of the work together.

Nulls, empty and odd rows: a null text counts as empty (0 tokens, the hash of no
bytes); a very long text is encoded whole, alone in its batch; a null id stays null;
repeated rows give repeated results; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hf_tokenizer, record_batch, slices, table
from .words import WordIds

TOKENIZER = "word_bpe_49k.json"
#: One border in 2**CHUNK_BITS bytes, by a hash over the last 32 bytes.
CHUNK_BITS = 10
#: Words on either side of a join that are encoded anew at first.
WINDOW = 2
#: Bounds of a worker's memory: bytes of chunks with their ids, and words.
CACHED_BYTES = 32 << 20
CACHED_WORDS = 300_000

_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)


def borders(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of ``data``, UTF-8, the last one its length; none is inside
    a character."""
    if not data:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < 32:  # the hash of a window from those of its halves
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
        step *= 2
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    if not len(cuts):
        return [len(data)]
    inner = np.concatenate([np.frombuffer(data, np.uint8) & 0xC0 == 0x80, [False]])
    while inner[cuts].any():
        cuts = cuts + inner[cuts]
    cuts = np.unique(cuts).tolist()
    return cuts if cuts[-1] == len(data) else [*cuts, len(data)]


def tail(chunk: bytes, words: int) -> bytes:
    """The last words of ``chunk``, with the white space before and behind them."""
    return chunk[len(chunk.rsplit(None, words)[0]) :]


def head(chunk: bytes, words: int) -> bytes:
    """The first words of ``chunk``, with the white space before and behind them."""
    return chunk[: len(chunk) - len(chunk.split(None, words)[words])]


class ChunkEncoder:
    """Encodes texts, with memories of chunks and of words.

    A chunk's encoding is its ids and, for each of its words, where its ids end.
    """

    def __init__(self, tokenizer: str, bits: int = CHUNK_BITS, window: int = WINDOW):
        self.tokenizer, self.bits, self.window = hf_tokenizer(tokenizer), bits, window
        self.words = WordIds(tokenizer, CACHED_WORDS)
        probe = "Ab,  cd\n\tef é"
        self.wordwise = self.encode(probe).tolist() == [i for w in probe.split() for i in self.encode(w).tolist()]
        self.chunks: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.size = self.reused = self.made = self.joins = self.widened = 0

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, by the tokenizer."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def cut(self, text: bytes) -> list[bytes]:
        """The chunks of ``text``, each of more than two windows' words unless it has
        no more."""
        out: list[bytes] = []
        start, open_, least = 0, b"", 2 * self.window + 1
        for end in borders(text, self.bits):
            open_ += text[start:end]
            start = end
            if len(open_.split(None, least)) > least:
                out.append(open_)
                open_ = b""
        if open_:
            if out:
                out[-1] += open_
            else:
                out.append(open_)
        return out

    def learn(self, chunks: list[bytes]) -> None:
        """Encodes chunks that aren't known: by words, if the tokenizer joins nothing
        across white space and has no ids for it."""
        if not self.wordwise:
            for chunk, x in zip(chunks, self.tokenizer.encode_batch([c.decode() for c in chunks], add_special_tokens=False), strict=True):
                ends = [m.end() for m in re.finditer("[^ \t\n\r\x0b\x0c]+", chunk.decode())]
                self.chunks[chunk] = np.array(x.ids, np.uint32), np.searchsorted([b for _, b in x.offsets], ends, side="right")
                self.size += len(chunk) + 4 * len(x.ids) + 8 * len(ends) + 400
            return
        ids, stop, counts = self.words.encode(pa.array([c.decode() for c in chunks], pa.large_string()))
        at = np.concatenate([[0], np.cumsum(counts)])
        stop = np.concatenate([[0], stop])
        for chunk, a, b in zip(chunks, at.tolist(), at[1:].tolist(), strict=False):
            self.chunks[chunk] = ids[stop[a] : stop[b]].copy(), stop[a + 1 : b + 1] - stop[a]
            self.size += len(chunk) + 4 * int(stop[b] - stop[a]) + 8 * (b - a) + 400

    def agrees(self, left: bytes, right: bytes, words: int, ids: list[int]) -> bool:
        """Whether a window's ids begin as the left chunk's and end as the right one's."""
        (a, x), (b, y) = self.chunks[left], self.chunks[right]
        before, behind = a[x[-words - 1] : x[-2]].tolist(), b[y[0] : y[words - 1]].tolist()
        return len(ids) >= len(before) + len(behind) and ids[: len(before)] == before and (not behind or ids[-len(behind) :] == behind)

    def join(self, own: list[bytes], windows: dict[bytes, list[int]]) -> np.ndarray:
        """The ids of a text from those of its chunks and windows."""
        parts: list[np.ndarray] = []
        start = 0
        width = self.window
        for left, right in zip(own, own[1:], strict=False):
            words, found = self.window, windows[tail(left, self.window) + head(right, self.window)]
            while not self.agrees(left, right, words, found):
                self.widened += 1
                words *= 2
                if words + width >= min(len(self.chunks[left][1]), len(self.chunks[right][1])):
                    return self.encode(b"".join(own).decode())
                found = self.encode((tail(left, words) + head(right, words)).decode()).tolist()
            width = words
            (a, x), (_, y) = self.chunks[left], self.chunks[right]
            parts += [a[start : x[-words - 1]], np.array(found, np.uint32)]
            start = y[words - 1]
        return np.concatenate([*parts, self.chunks[own[-1]][0][start:]])

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts."""
        if self.size > CACHED_BYTES:
            self.chunks.clear()
            self.size = 0
        cut = [self.cut(t) for t in texts]
        every = [c for own in cut for c in own]
        fresh = [c for c in dict.fromkeys(every) if c not in self.chunks]
        self.made, self.reused = self.made + len(fresh), self.reused + len(every) - len(fresh)
        if fresh:
            self.learn(fresh)
        seams = [tail(a, self.window) + head(b, self.window) for own in cut for a, b in zip(own, own[1:], strict=False)]
        self.joins += len(seams)
        found = list(dict.fromkeys(seams))
        windows = {w: x.ids for w, x in zip(found, self.tokenizer.encode_batch_fast([w.decode() for w in found], add_special_tokens=False), strict=True)}
        none = np.zeros(0, np.uint32)
        return [self.join(own, windows) if own else none for own in cut]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The tokenizer's texts of these ids."""
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(tokenizer: str, bits: int = CHUNK_BITS) -> ChunkEncoder:
    """This process's encoder, with what it has cached."""
    if (tokenizer, bits) not in _encoders:
        _encoders[tokenizer, bits] = ChunkEncoder(tokenizer, bits)
    return _encoders[tokenizer, bits]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, bits: int = CHUNK_BITS) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        own = encoder(tokenizer, bits)
        for batch, texts in slices(batches):
            ids = own.encode_all(texts)
            yield record_batch({"doc_id": batch.column(0), "ids": [x.astype(np.int32) for x in ids], "decoded": own.decode_all(ids)}, schema)

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str = TOKENIZER, bits: int = CHUNK_BITS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``docs``, hashed where
    they are encoded so that the ids themselves aren't moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        own = encoder(tokenizer, bits)
        for batch, texts in slices(batches):
            ids = own.encode_all(texts)
            n = [len(x) for x in ids]
            numbers = pa.array(np.concatenate(ids)).cast(pa.large_string())
            listed = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), numbers), pa.scalar(" ", pa.large_string()))
            yield record_batch({"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": [_sha(x) for x in listed.to_pylist()], "decoded_sha256": [_sha(x) for x in own.decode_all(ids)]}, schema)

    return _narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all ``documents``."""
    return digests(table(spark, sf_dir, "documents"))
