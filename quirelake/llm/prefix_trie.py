"""A trie of conversations by their turns.

Each turn is digested once where it is read, so no text is moved after that.  Running
sums over a conversation (:mod:`.running`: range-sorted, scanned with numpy) of turn
values times powers of a base give polynomial fingerprints of all its prefixes, modulo
two primes.  Prefixes of one depth and fingerprint are candidates for one node; every
member's turn is compared with that of the node's representative, the smallest
conversation, by its whole SHA-256.  As the fingerprint is a sum, equal fingerprints and
equal last turns mean equal fingerprints one turn earlier, so where all turns of all
groups agree, so do all prefixes.  Members that differ get other values for those turns,
and the scan is repeated until no group has any.

Rollup: a conversation is the representative of a suffix of its path, its own part.
With the bytes before that part, and whether it ends in a leaf, a subtree's sums are
plain sums over the members of its top, so no round for each level is needed.

Nulls, empty and odd rows: a row without conversation is left out; a null role or text
is empty; turns are in order of turn (null first), then role, then digest; repeated rows
are turns of their own; a conversation of any length spans ranges; very long texts are
digested whole; other columns are ignored; without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free_memory, record_batch, table, written
from .running import range_count, running

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 1_299_709)
DIGEST = ["d0", "d1", "d2", "d3"]
NODE = ["pos", "f1", "f2"]
#: Bytes of conversation ids that are sent as one row at most.
PIECE = 64 << 10
EMPTY = hashlib.sha256().hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), *((d, pa.int64()) for d in DIGEST), ("n_bytes", pa.int64()), ("salt", pa.int64())])
    for batch in batches:
        roles = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        texts = [x or b"" for x in batch.column(3).cast(pa.large_binary()).to_pylist()]
        found = np.frombuffer(b"".join(hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest() for r, t in zip(roles, texts, strict=True)), ">i8").astype(np.int64).reshape(-1, 4)
        made = {"conv_id": batch.column(0), "turn": batch.column(1), "role": pa.array(roles, pa.binary()).cast(pa.string()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "salt": batch.column(4)}
        yield record_batch(made | {d: pa.array(found[:, i]) for i, d in enumerate(DIGEST)}, schema)
    free_memory()


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d0..d3, n_bytes) of ``conversations`` (conv_id, turn, role, text):
    turns by their places from 0, their digests and the bytes of their texts."""
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    turns = written(rows.mapInArrow(_digests, "conv_id long, turn long, role string, d0 long, d1 long, d2 long, d3 long, n_bytes long, salt long"), "turns")
    placed = running(turns.withColumn("one", F.lit(1).cast("long")), ["conv_id"], [F.col(c).asc_nulls_first() for c in ("turn", "role", *DIGEST, "salt")], ["one"], tag="turn-places")
    out = placed.select("conv_id", F.col("one_before").alias("pos"), *DIGEST, "n_bytes")
    out.written_to = placed.written_to
    dropped(turns)
    return out


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return out


def _terms(primes: tuple[int, int]):
    """Adds each turn's summands of both fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()
            made = []
            for i, prime in enumerate(primes):
                x = get(DIGEST[i]).view(np.uint64) ^ (get("again").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(32))) % np.uint64(prime)
                made.append(pa.array((x * _powers(BASES[i], get("pos") + 1, prime) % np.uint64(prime)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "f1", "f2"])

    return run


def fingerprints(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``turns`` (conv_id, pos, d0..d3, n_bytes, again) with fingerprints f1, f2 of the
    prefix that ends with the turn, u1, u2 of the one before, and ``before``, the bytes
    of all texts before."""
    kinds = ", ".join(f"{n} {t}" for n, t in turns.dtypes) + ", f1 bigint, f2 bigint"
    modulus = dict(zip(("f1", "f2"), primes, strict=True))
    sums = running(turns.mapInArrow(_terms(primes), kinds), ["conv_id"], [F.col("pos").asc()], ["f1", "f2", "n_bytes"], modulus, rows=turns.count(), tag="prefixes")
    whole = [F.pmod(F.col(f) + F.col(f"{f}_before"), F.lit(p)).alias(f) for f, p in modulus.items()]
    out = sums.select("conv_id", "pos", *DIGEST, "n_bytes", "again", *whole, F.col("f1_before").alias("u1"), F.col("f2_before").alias("u2"), F.col("n_bytes_before").alias("before"))
    out.written_to = sums.written_to
    return out


def _groups(prefixes: DataFrame) -> DataFrame:
    """Candidates for nodes: the representative, what it and others have, and whether
    all have the representative's turn."""
    same = [F.min(d) == F.max(d) for d in DIGEST]
    alike = same[0] & same[1] & same[2] & same[3]
    own = [F.min_by("before", "conv_id").alias("before"), F.min("n_bytes").alias("n_bytes"), F.min("u1").alias("u1"), F.min("u2").alias("u2")]
    return prefixes.groupBy(*NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), alike.alias("alike"), *own)


def grouped(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """The prefixes of ``turns`` and their nodes, after verification of every member;
    both are written."""
    turns = turns.withColumn("again", F.lit(0).cast("long"))
    spare: list[DataFrame] = []
    for attempt in range(1, 100):
        prefixes = fingerprints(turns, primes)
        nodes = written(_groups(prefixes), "nodes")
        wrong = nodes.filter(~F.col("alike")).select(*NODE)
        if not wrong.limit(1).count():
            dropped(*spare)
            return prefixes, nodes
        met = prefixes.join(wrong, NODE)  # few: only groups with a collision
        first = met.groupBy(*NODE).agg(F.min_by(F.struct(*DIGEST), "conv_id").alias("turn"))
        differ = met.join(first, NODE).filter(F.struct(*DIGEST) != F.col("turn")).select("conv_id", "pos", F.lit(attempt).cast("long").alias("__again"))
        split = prefixes.join(differ, ["conv_id", "pos"], "left").select("conv_id", "pos", *DIGEST, "n_bytes", F.coalesce("__again", "again").alias("again"))
        turns = written(split, "split-turns")
        dropped(prefixes, nodes)
        spare.append(turns)
    raise RuntimeError("fingerprints collide after 99 rounds")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node's ids, which come in order, as texts of ``PIECE`` bytes at most."""
    schema = pa.schema([(c, pa.int64()) for c in (*NODE, "place", "nth")] + [("ids", pa.binary())])
    place, nth = TaskContext.get().partitionId(), 0
    node, ids, size = None, [], 0
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for *own, conv in zip(*columns, strict=True):
            if ids and (own != node or size > PIECE):
                rows.append((*node, place, nth, b",".join(ids)))
                nth, ids, size = nth + 1, [], 0
            node = own
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
        yield record_batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)
    if ids:
        yield record_batch(dict(zip(schema.names, ([x] for x in (*node, place, nth, b",".join(ids))), strict=True)), schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come in order."""
    schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
    node, state = None, hashlib.sha256()
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 5)]
        for *own, ids in zip(*columns, strict=True):
            if own != node:
                if node:
                    rows.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield record_batch({f.name: [r[i] for r in rows] for i, f in enumerate(schema)}, schema)
    if node:
        yield record_batch(dict(zip(schema.names, ([x] for x in (*node, state.hexdigest())), strict=True)), schema)


def ends(last: DataFrame, rows: int) -> DataFrame:
    """(pos, f1, f2, ends_sha256) of ``last`` (pos, f1, f2, conv_id), a row for each
    conversation: ids are joined to pieces in sorted ranges, so that a node where many
    conversations end is few rows when it is hashed."""
    by = [*NODE, "conv_id"]
    many = range_count(last, rows)
    pieces = last.select(*by).repartitionByRange(many, *by).sortWithinPartitions(*by).mapInArrow(_pieces, "pos long, f1 long, f2 long, place long, nth long, ids binary")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "place", "nth").mapInArrow(_hashed, "pos long, f1 long, f2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): the nodes of ``turns`` (conv_id, pos, d0..d3, n_bytes), which end
    conversations of ``convs`` (conv_id), those without turns at the root."""
    prefixes, nodes = grouped(turns, primes)
    up = [F.col("pos") - 1, F.col("u1"), F.col("u2")]
    children = nodes.groupBy(*(c.alias(n) for c, n in zip(up, NODE, strict=True))).agg(F.count(F.lit(1)).alias("n_children"))
    whole = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    own = whole.groupBy(F.col("rep").alias("conv_id")).agg(F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    lengths = prefixes.groupBy("conv_id").agg(F.max("pos").alias("last"), F.max(F.col("before") + F.col("n_bytes")).alias("bytes"))
    zero = F.lit(0).cast("long")
    each = convs.select("conv_id").join(lengths, "conv_id", "left").join(own, "conv_id", "left")
    each = written(each.select("conv_id", F.coalesce("last", F.lit(-1).cast("long")).alias("last"), F.coalesce("shared", "bytes", zero).alias("shared"), F.coalesce("leaf", zero).alias("leaf")), "trie-conversations")
    path = prefixes.select("conv_id", "before", *NODE).join(each, "conv_id")
    sums = path.groupBy(*NODE).agg(F.sum(F.greatest(zero, F.col("shared") - F.col("before"))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    last = path.filter("pos = last").select(*NODE, "conv_id").unionByName(each.filter("last < 0").select(F.lit(-1).cast("long").alias("pos"), zero.alias("f1"), zero.alias("f2"), "conv_id"))
    ended = written(ends(last, each.count()), "trie-ends")
    parents = whole.select((F.col("pos") + 1).alias("__pos"), F.col("f1").alias("__f1"), F.col("f2").alias("__f2"), F.col("rep").alias("__rep"))
    found = whole.join(sums, NODE).join(ended, NODE, "left")
    found = found.join(parents, (F.col("pos") == F.col("__pos")) & (F.col("u1") == F.col("__f1")) & (F.col("u2") == F.col("__f2")), "left")
    total = each.agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.sum("shared").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).filter("n_convs > 0").first()  # one row
    columns = [F.col("rep").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("__rep").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    if total is None:
        return found.select(*columns)
    heads = whole.filter("pos = 0").count()
    root_end = ended.filter("pos < 0").select("ends_sha256").first()
    root = each.sparkSession.createDataFrame([(total.rep, 0, None, total.n_convs, heads, total.n_leaves if heads else 1, total.saved_tokens, root_end[0] if root_end else EMPTY)], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    below = found.select(*columns).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(total.rep)).otherwise(F.col("parent_conv_id")))
    out = written(root.unionByName(below), "trie")
    dropped(prefixes, nodes, whole, each, ended)
    return out


def conversation_trie(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    turns = numbered(conversations)
    return trie(turns, turns.select("conv_id").distinct(), primes)


def _kept(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each has got the beginning of its base: the first
    h turns of conversation c - c % 5, then its own after its first h."""
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = lambda c: c - c % 5
    conv = F.col("conv_id")
    family = lengths.groupBy(base(conv).alias("base")).agg(F.collect_list(F.struct("conv_id", _kept(conv).alias("h"))).alias("members"), F.max(F.when(conv == base(conv), F.col("n"))).alias("n_base"))  # nine at most
    met = turns.withColumn("base", base(conv)).join(family, "base")
    own = F.filter(F.array(F.struct(conv.alias("conv_id"), (F.col("pos") - _kept(conv) + F.least(_kept(conv), F.coalesce("n_base", F.lit(0)))).alias("pos"))), lambda x: F.col("pos") >= _kept(conv))
    given = F.transform(F.filter("members", lambda m: (conv == F.col("base")) & (m["h"] > F.col("pos"))), lambda m: F.struct(m["conv_id"].alias("conv_id"), F.col("pos").alias("pos")))
    to = F.explode(F.concat(own, given))
    return met.select(to.alias("to"), *DIGEST, "n_bytes").select("to.conv_id", "to.pos", *DIGEST, "n_bytes"), lengths.select("conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, rebuilt."""
    turns = numbered(table(spark, sf_dir, "conversations"))
    made, convs = rebuilt(turns)
    made, convs = written(made, "rebuilt-turns"), written(convs, "rebuilt-conversations")
    dropped(turns)
    out = trie(made, convs)
    dropped(made, convs)
    return out


ORACLE = r"""WITH ids AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), CAST(range(8) AS BIGINT[])), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 9 AS h FROM ids),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos < c.h UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos >= c.h LEFT JOIN ids b ON b.conv_id = c.base),
p AS (SELECT conv_id, pos + 1 AS depth, strlen(text) AS bytes, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key, depth),
e AS (SELECT p.key, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN l ON l.conv_id = p.conv_id AND p.depth = last GROUP BY p.key),
u AS (SELECT n.*, q.key AS up FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT up, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.up = u.key),
t AS (SELECT q.key, sum((w.n_convs - 1) * w.bytes) AS saved_tokens, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM w JOIN p q ON q.conv_id = w.conv_id AND q.depth <= w.depth GROUP BY q.key)
SELECT w.conv_id, w.depth, m.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM w JOIN t ON t.key = w.key LEFT JOIN n m ON m.key = w.up LEFT JOIN e ON e.key = w.key"""
