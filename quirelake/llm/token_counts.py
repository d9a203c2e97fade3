"""Token counts by a map-side lookup in two tiers.

Tier one is a compact table of the most frequent pre-tokens and their numbers of
tokens, of a fixed number of entries, that every executor gets.  Tier two is a bounded
cache in each Python worker: pre-tokens that the table hasn't are encoded once by the
tokenizer and remembered.  A worker also remembers the counts of whole words, so that
only new words are cut into pre-tokens.  What is shuffled is a count for each of a
task's distinct pre-tokens.

A word is what stands between ASCII white space.  The tokenizer's normaliser and
pre-tokeniser never join or compare anything across white space, so a text's count
is the sum over its words, and a word's over its pre-tokens.

The table's pre-tokens are the most frequent of all texts, by a pass that counts them
before: it decides on speed alone, and every text is counted whole.

Nulls, empty and odd rows: a null text counts as empty and has 0 tokens; a very long
text is counted whole, alone in its batch; a null id stays null; repeated rows give
repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, hf_tokenizer, record_batch, table, text_slices, written
from .words import told_apart

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of the table.
FREQUENT = 40_000
#: Longest pre-token of the table; longer ones are left to the workers' caches.
LONGEST = 64
#: Pre-tokens, and words, that a worker remembers at a time besides the table.
CACHED = 300_000

_LETTERS_SIGNS = re.compile("([A-Za-z]+)([!-&(-/:-@\\[-`{-~]*)")


class PreTokens:
    """The pre-tokens of words, by a tokenizer's own normaliser and pre-tokeniser."""

    def __init__(self, tokenizer: str):
        self.tokenizer = hf_tokenizer(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # letters and signs are told apart without it where it does just that
        self.simple = self.split("Ab'c") == ["ab", "'", "c"] and self.split("Abc,!") == ["abc", ",!"]

    def split(self, word: str) -> list[str]:
        """The pre-tokens of a word without special tokens."""
        own = self.tokenizer
        text = own.normalizer.normalize_str(word) if own.normalizer else word
        return [text[a:b] for _, (a, b) in own.pre_tokenizer.pre_tokenize_str(text)] if own.pre_tokenizer else [text]

    def of(self, word: str) -> list[str]:
        """The pre-tokens of a word; one with special tokens is its only one."""
        m = _LETTERS_SIGNS.fullmatch(word) if self.simple else None
        if any(x in word for x in self.special):
            return [word]
        if m:
            return [m[1].lower(), m[2]] if m[2] else [m[1].lower()]
        return self.split(word)

    def lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        return [len(x) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def frequent(docs: DataFrame, tokenizer: str = TOKENIZER, entries: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all ``docs``: at most ``entries`` of at most
    ``LONGEST`` characters, ties to the least.  Tasks count words, which are cut once a
    task or whenever there are ``CACHED``, and Spark adds the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PreTokens(tokenizer)
        schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

        def cut(seen: Counter[str]) -> pa.RecordBatch:
            pieces: Counter[str] = Counter()
            for word, n in seen.items():
                for piece in own.of(word):
                    pieces[piece] += n
            kept = [(w, n) for w, n in pieces.items() if len(w) <= LONGEST]
            return record_batch({"piece": [w for w, _ in kept], "n": [n for _, n in kept]}, schema)

        seen: Counter[str] = Counter()
        for _, texts in text_slices(batches):
            words, at, _ = told_apart(texts)
            for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                if n:
                    seen[word] += n
            if len(seen) > CACHED:
                yield cut(seen)
                seen.clear()
        yield cut(seen)

    counts = docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # written, as a collected limit sends every partition's ``entries`` to the driver
    top = written(counts.orderBy(F.desc("n"), "piece").limit(entries), "pre-tokens")
    found = sorted(top.collect(), key=lambda r: (-r.n, r.piece))  # ``entries``
    dropped(top)
    return [r.piece for r in found]


class Counting:
    """Counts words by the table, then by what the worker remembers."""

    def __init__(self, pieces: list[str], lengths: np.ndarray, tokenizer: str):
        self.pre = PreTokens(tokenizer)
        self.table = dict(zip(pieces, lengths.tolist(), strict=True))
        self.more: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Counts words that aren't known."""
        cut = [self.pre.of(w) for w in words]
        unknown = [p for p in dict.fromkeys(p for own in cut for p in own) if p not in self.table and p not in self.more]
        self.more.update(zip(unknown, self.pre.lengths(unknown), strict=True))
        for word, own in zip(words, cut, strict=True):
            self.words[word] = sum(self.table[p] if p in self.table else self.more[p] for p in own)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        if len(self.words) > CACHED:
            self.words.clear()
        if len(self.more) > CACHED:
            self.more.clear()
        words, at, counts = told_apart(texts)
        missing = [w for w in words if w not in self.words]
        if missing:
            self.learn(missing)
        n = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        return np.diff(np.concatenate([[0], np.cumsum(n[at])])[np.concatenate([[0], np.cumsum(counts)])])


#: Of this process, by broadcast.
_counting: dict[object, Counting] = {}


def _counter(shared, key: object, tokenizer: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        if key not in _counting:
            _counting.clear()
            blob, lengths = shared.value
            _counting[key] = Counting(blob.split(" ") if len(lengths) else [], lengths, tokenizer)
        for batch, texts in text_slices(batches):
            n = _counting[key].count(texts)
            yield record_batch({"doc_id": batch.column(0), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}, schema)

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, entries: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = frequent(docs, tokenizer, entries)
    # pre-tokens have no white space, so one space parts them
    shared = docs.sparkSession.sparkContext.broadcast((" ".join(pieces), np.array(PreTokens(tokenizer).lengths(pieces), np.uint32)))
    return docs.mapInArrow(_counter(shared, uuid.uuid4().hex, tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``."""
    return token_counts(table(spark, sf_dir, "documents"))
