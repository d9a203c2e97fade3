"""Removal of lines that many documents share, by two Bloom filters.

Every task puts the keys of its documents' lines into two filters: keys seen
once, and keys seen (perhaps) twice.  Merged over all tasks, the second holds
every key that two documents share.  Only lines found in it, the suspects, go
through a shuffle, once for each key (by 128-bit hash) and document, to be counted
exactly; there the first occurrence is chosen too, for callers that keep it.

The filters have about eight bits for each line of usual length, up to ``MOST_BITS``
(128 MB) each; tables of more than about 25 GB fill them beyond that, so that more of
the lines are suspects, which costs shuffles (32 bytes a line) but changes no result.

A key is a line without white space at both ends, A-Z in lower case.  A key that
at least ``min_docs`` documents hold loses all its lines, or all but the first.

The keys to drop are broadcast while they are few (``BROADCAST_KEYS``, counted
first); beyond that they are joined to the suspects and the result to the
documents; there adaptive execution splits the rows of one text that many have.

Nulls, empty and odd rows: a null or empty text is one empty line, which has no
key and stays (a null text stays null); a very long text is read whole, alone in its
batch; rows of one doc_id are one document, and rows without an id lose the lines that
documents share but count as none; ties cannot arise, since the first occurrence is
the least (doc_id, line number); other columns are carried
unless they are named as one of the operator's own (n_lines, n_dropped), which
replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import input_bytes, slices, table, written

MIN_DOCS = 10
MIN_CHARS = 1
#: Bits of each Bloom filter: 40 for each KB of the input, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
#: Bytes of a filter that travel in one row.
BLOCK = 1 << 16
#: Most keys to drop that are broadcast (about 100 bytes each in a worker).
BROADCAST_KEYS = 300_000

_SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The key of each line; empty where it has fewer than ``min_chars``."""
    found = [line.strip(_SPACE) for line in text.lower().split(b"\n")]
    return found if min_chars <= 1 else [k if len(k.decode()) >= min_chars else b"" for k in found]


def _probe(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _has(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in _probe(h, bits):
        found &= (filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _put(filter_: np.ndarray, h: np.ndarray, bits: int) -> None:
    for p in _probe(h, bits):
        np.bitwise_or.at(filter_, p >> np.uint64(3), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def filter_bits(docs: DataFrame) -> int:
    """The filters' size, from the optimiser's estimate of the input's bytes."""
    size = input_bytes(docs)
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, size // 24 - 1).bit_length()))


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> bytes:
    """A Bloom filter that has every key of two documents or more."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for _, texts in slices(batches):
            # a document's repeated rows may only add to what is suspected
            found = [xxhash.xxh3_64_intdigest(k) for t in texts for k in set(keys_of(t, min_chars)) if k]
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            _put(twice, h[(n > 1) | _has(once, h, bits)], bits)
            _put(once, h, bits)
        for i in range(0, bits // 8, BLOCK):
            if once[i : i + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": [i // BLOCK], "once": [zlib.compress(once[i : i + BLOCK].tobytes(), 1)], "twice": [zlib.compress(twice[i : i + BLOCK].tobytes(), 1)]}, pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    def merge(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in groups:
            for block, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if block in once:
                    twice[block] |= b | (once[block] & a)
                    once[block] |= a
                else:
                    once[block], twice[block] = a.copy(), b.copy()
        for block, b in twice.items():
            if b.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "twice": [zlib.compress(b.tobytes(), 1)]}, pa.schema([("block", pa.int32()), ("twice", pa.binary())]))

    blocks = docs.select("text").mapInArrow(fill, "block int, once binary, twice binary").repartition("block").mapInArrow(merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.collect():  # one filter in all, whose size is bounded
        part = np.frombuffer(zlib.decompress(row.twice), np.uint8)
        out[row.block * BLOCK : row.block * BLOCK + len(part)] = part
    return out.tobytes()


def repeated_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key binary, n_docs long, first_doc long, first_line long): the 128-bit hash
    of each key that at least ``min_docs`` documents hold."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = filter_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("line", pa.int64())])
        twice = np.frombuffer(shared.value, np.uint8)
        for batch, texts in slices(batches):
            keys: list[bytes] = []
            docs_: list[int] = []
            lines: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if doc is None:
                    continue
                own: dict[bytes, int] = {}
                for i, k in enumerate(keys_of(text, min_chars)):
                    if k:
                        own.setdefault(k, i)
                keys += own
                docs_ += [doc] * len(own)
                lines += own.values()
            if keys:
                hit = np.flatnonzero(_has(twice, np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)), bits)).tolist()
                yield pa.RecordBatch.from_pydict({"key": [xxhash.xxh3_128_digest(keys[i]) for i in hit], "doc": [docs_[i] for i in hit], "line": [lines[i] for i in hit]}, schema)

    by_doc = docs.mapInArrow(suspects, "key binary, doc long, line long").groupBy("key", "doc").agg(F.min("line").alias("line"))
    return by_doc.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc", "line")).alias("first")).filter(F.col("n_docs") >= min_docs).select("key", "n_docs", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))


def _rewrite(doc: int | None, text: bytes | None, drop, keep_first: bool, min_chars: int) -> tuple[bytes | None, int, int]:
    """``text`` without the lines whose key's hash is in ``drop``, a mapping to the
    first occurrence; the lines before and those dropped."""
    lines = (text or b"").split(b"\n")
    kept = []
    for i, (line, key) in enumerate(zip(lines, keys_of(text or b"", min_chars), strict=True)):
        first = drop.get(xxhash.xxh3_128_digest(key)) if key else None
        if first is None or keep_first and first == (doc, i):
            kept.append(line)
    return text if text is None or len(kept) == len(lines) else b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with their texts rewritten, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")}).drop("n_lines", "n_dropped")
    keys = written(repeated_keys(docs, min_docs, min_chars), "line-keys")
    out = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch], drops) -> Iterator[pa.RecordBatch]:
        """``drops``: the mapping for each row, given the batch."""
        at = names.index("text")
        for batch, _ in slices(batches):
            ids, texts = batch.column(names.index("doc_id")).to_pylist(), batch.column(at).cast(pa.large_binary()).to_pylist()
            found = [_rewrite(i, t, d, keep_first, min_chars) for i, t, d in zip(ids, texts, drops(batch), strict=True)]
            columns = [*batch.columns[: len(names)], pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())]
            columns[at] = pa.array([x[0] for x in found], pa.large_binary()).cast(pa.large_string()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped"])

    if keys.count() <= broadcast_keys:
        drop = {bytes(r.key): (r.first_doc, r.first_line) for r in keys.toLocalIterator()}
        shared = spark.sparkContext.broadcast(drop)

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from rewrite(batches, lambda b: [shared.value] * b.num_rows)

        return docs.mapInArrow(by_broadcast, out)

    def own_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            for t in texts:
                own = {xxhash.xxh3_128_digest(k) for k in keys_of(t, min_chars) if k}
                yield pa.RecordBatch.from_pydict({"row": [xxhash.xxh3_128_digest(t)] * len(own), "key": list(own)}, pa.schema([("row", pa.binary()), ("key", pa.binary())]))

    @F.pandas_udf(T.BinaryType())
    def row_hash(text: pd.Series) -> pd.Series:
        return text.map(lambda t: xxhash.xxh3_128_digest((t or "").encode()))

    # Rows of one text have the same lines to drop, so the text's hash names them.
    hits = docs.select("text").mapInArrow(own_keys, "row binary, key binary").distinct().join(keys, "key").groupBy("row").agg(F.collect_list(F.struct("key", "first_doc", "first_line")).alias("__drop"))

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rewrite(batches, lambda b: [{d["key"]: (d["first_doc"], d["first_line"]) for d in x or []} for x in b.column(b.schema.get_field_index("__drop")).to_pylist()])

    return docs.withColumn("__row", row_hash("text")).join(hits.withColumnRenamed("row", "__row"), "__row", "left").select(*names, "__drop").mapInArrow(by_join, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the lines that ten or more of them share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, bad.key IS NOT NULL AS dropped FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
