"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has ``HASHES`` Gaussian (2-stable) projections of the unit vectors, each
cut into cells of width ``WIDTH`` at a random offset; a bucket is a tuple of
cells.  A neighbour at distance r of a query has projections that differ from the
query's by Gaussian amounts of deviation r, so the probability that it is in a
given bucket is a product of normal integrals.  A query visits a table's buckets
in falling order of that estimate, its own and perturbed ones alike, until their
sum reaches the table's share of ``SUCCESS`` at r = ``RADIUS``.  Candidates of all
tables are reranked by their exact cosine.

1. Equal vectors become one, with its ``k + 1`` least ids: no more of them can be
   among the nearest, because ties go to the smaller id.
2. The index has every distinct vector once, with its bucket in each table, sorted by
   the first of them.  Its rows are dealt out by files, so a bucket of any size has as
   many tasks as it needs.
3. Each query's estimates become a table of log probabilities by hash and cell, and
   for each table the least estimate of a bucket that it visits.  Blocks of
   ``QUERY_BLOCK`` queries (about 1 KB each) are broadcast, ``WAVE`` of them in a job,
   and each goes over the index once: vectors of the same buckets are multiplied with
   the queries that visit any of these, and with no others, so the products are the
   tables' merged candidates.  The k + 1 nearest so far are kept: no vector is shuffled
   and no pair becomes a row.
4. That is done by rising ``RADII``.  A query is finished when its k-th nearest found is
   within the radius that it was planned for (the last time: when it found k at all);
   the others go on to the next radius, and at the end to all buckets, without those
   visited before.  So a query with near neighbours visits few buckets, and only one
   without them visits most.

Nulls, empty and odd rows: vectors that are null, zero or hold null or non-finite
components, rows with a null id, and vectors of another length than most have (ties
to the greater length) take no part, as queries or candidates; very large or small
components are scaled by powers of two first; repeated rows are one; a query's own id
is no candidate; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import new_path
from .common import dropped, input_bytes, table, written

K = 5
TABLES, HASHES, WIDTH = 3, 10, 1.6
#: Cells of a projection that are told apart; those beyond count as the last ones.
CELLS = 3
#: The distances of unit vectors that probing is planned for, one after the other:
#: cosines of about 0.9 and 0.26.
RADII = (0.45, 1.22)
#: Estimated probability that a neighbour at that distance is in a visited bucket.
SUCCESS = 0.9995
SEED = 20
#: Queries of one pass over the index, and passes that one job makes beside each other.
QUERY_BLOCK, WAVE = 8192, 8
#: Bytes of vectors of an index partition.
RANGE_BYTES = 128 << 20
#: Queries and vectors that are multiplied at once.
TILE_QUERIES, TILE_ROWS = 512, 2048
#: Steps of a table's log probabilities in which its share is measured.
STEPS = 4096

#: What a query has when it is planned for some radii, and what a pass finds.
PLANS = "query_id long, q binary, logs binary, floors binary"
FOUND = "query_id long, vec_id long, score double"

_erf = np.vectorize(math.erf, otypes=[float])


def _hashes(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return rng.normal(size=(TABLES * HASHES, dim)), rng.uniform(0, WIDTH, TABLES * HASHES)


def _places(unit: np.ndarray) -> np.ndarray:
    """Projections in cell widths, one where the middle cell of three begins; by row,
    table and hash."""
    a, b = _hashes(unit.shape[1])
    return ((unit @ a.T + b) / WIDTH + CELLS // 2).reshape(len(unit), TABLES, HASHES)


def buckets(unit: np.ndarray) -> np.ndarray:
    """The bucket of each vector in each table, as a number: the first hash has the
    lowest digit."""
    cells = np.clip(np.floor(_places(unit)), 0, CELLS - 1).astype(np.int64)
    return cells @ (CELLS ** np.arange(HASHES, dtype=np.int64))


def plans(unit: np.ndarray, radius: float = RADII[-1]) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities by query, table, hash and cell, and by query and table the
    least of a bucket that the query visits, for neighbours at ``radius``."""
    share = 1 - (1 - SUCCESS) ** (1 / TABLES)
    edges = np.arange(1, CELLS)
    below = 0.5 * (1 + _erf((edges - _places(unit)[..., None]) * WIDTH / (radius * math.sqrt(2))))
    within = np.diff(np.concatenate([np.zeros((*below.shape[:3], 1)), below, np.ones((*below.shape[:3], 1))], axis=3), axis=3)
    logs = np.log(np.maximum(within, 1e-30))
    floors = np.zeros((len(unit), TABLES))
    for i in range(len(unit)):
        for t in range(TABLES):
            every = np.zeros(1)
            for k in range(HASHES):
                every = np.add.outer(logs[i, t, k], every).ravel()
            top = float(every.max())
            # mass by steps of the log probability below the most probable bucket's
            step = np.minimum(((top - every) * (STEPS / 40)).astype(np.int64), STEPS - 1)
            mass = np.cumsum(np.bincount(step, np.exp(every), STEPS))
            last = min(int(np.searchsorted(mass, share)), STEPS - 1)
            floors[i, t] = top - (last + 1) * (40 / STEPS) if last < STEPS - 1 else -np.inf
    return logs, floors


def visited(found: np.ndarray, logs: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Whether each query visits a bucket of each row (rows x tables), in any table."""
    out = np.zeros((len(logs), len(found)), bool)
    for t in range(TABLES):
        own, at = np.unique(found[:, t], return_inverse=True)
        p = np.zeros((len(logs), len(own)))
        for k in range(HASHES):
            p += logs[:, t, k, own // CELLS**k % CELLS]
        out |= (p >= floors[:, t, None])[:, at]
    return out


def products(q: np.ndarray, m: np.ndarray, found: np.ndarray, visits: list[tuple[np.ndarray, np.ndarray] | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, products of all of them) for rows ``m`` of the buckets ``found``:
    each pair that the last of ``visits`` (None: to all buckets) visits and no earlier
    one has, once, and no other pair."""
    own, at = np.unique(found, axis=0, return_inverse=True)
    mask = np.ones((len(q), len(own)), bool) if visits[-1] is None else visited(own, *visits[-1])
    for before in visits[:-1]:
        mask &= ~visited(own, *before)
    by = np.argsort(at.ravel(), kind="stable")
    for i, rows in enumerate(np.split(by, np.cumsum(np.bincount(at.ravel()))[:-1])):
        who = np.flatnonzero(mask[:, i])
        if len(who):
            yield who, rows, q[who] @ m[rows].T


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v: the components as doubles) of the rows that take part, and their
    length."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.filter(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = most[0]["n"] if most else 0
    return rows.filter(F.size("v") == dim), dim


def _matrix(packed) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in packed])


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled by powers of two so that their greatest component is about 1, and
    their lengths."""
    m = np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])
    return m, np.sqrt(np.einsum("ij,ij->i", m, m))


class Nearest:
    """The k + 1 nearest vectors so far of each of a block's queries, ties to those of
    the least id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.found: list[list[tuple[float, list[int]]]] = [[] for _ in range(n)]

    def add(self, first: int, scores: np.ndarray, ids: list[list[int]]) -> None:
        """``scores`` of queries from ``first`` on and of vectors with ``ids``; those
        that aren't candidates have -inf."""
        who, what = np.nonzero((scores >= self.floor[first : first + len(scores), None]) & (scores > -np.inf))
        for q, c, s in zip((who + first).tolist(), what.tolist(), scores[who, what].tolist(), strict=True):
            self.found[q].append((-s, ids[c]))
        for q in np.unique(who + first).tolist():
            own = self.found[q]
            if len(own) > self.k:
                own.sort()  # by score, then by the least id
                del own[self.k + 1 :]
                if len(own) > self.k:
                    self.floor[q] = -own[-1][0]

    def rows(self, own: list[int]) -> Iterator[tuple[int, int, float]]:
        """(query, id, score) of the k nearest ids other than the query's own."""
        for query, found in zip(own, self.found, strict=True):
            seen: dict[int, float] = {}
            for s, i in sorted((s, i) for s, ids in found for i in ids if i != query):
                if len(seen) < self.k:
                    seen.setdefault(i, s)
            for i, s in seen.items():
                yield query, i, -s


def search(vectors: DataFrame, every: int = 50, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, candidates) of the k nearest found of each row
    whose id is divisible by ``every``; candidates: how many products were
    computed for it."""
    spark = vectors.sparkSession
    rows, dim = _valid(vectors, vec_id, embedding)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, candidates long")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[bytes, list[int]] = {}
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            packed = np.ascontiguousarray(flat.reshape(-1, dim))
            for i, v in zip(batch.column(0).to_pylist(), packed, strict=True):
                own = least.setdefault(v.tobytes(), [])
                if i not in own:
                    own.append(i)
                    own.sort()
                    del own[k + 1 :]
            yield pa.RecordBatch.from_pydict({"v": list(least), "ids": list(least.values())}, pa.schema([("v", pa.binary()), ("ids", pa.list_(pa.int64()))]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = _scaled(_matrix(batch.column(0).to_pylist()))
                found = buckets(m / n[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array([x.tobytes() for x in found], pa.binary()), batch.column(0), batch.column(1)], names=["first", "buckets", "v", "ids"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, _ = _scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                none = pa.array([b""] * len(m), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary()), none, none], names=["query_id", "q", "logs", "floors"])

    def plan(radius: float):
        """Adds the plans for ``radius`` to those for the radii before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    m, n = _scaled(_matrix(part.column(1).to_pylist()))
                    found = plans(m / n[:, None], radius)
                    both = [pa.array([x + y.tobytes() for x, y in zip(part.column(c).to_pylist(), own, strict=True)], pa.binary()) for c, own in zip((2, 3), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *both], names=["query_id", "q", "logs", "floors"])

        return run

    ids = rows.mapInArrow(combine, "v binary, ids array<long>").select("v", F.explode("ids").alias("id")).distinct()
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(vectors) // RANGE_BYTES + 1)
    indexed = distinct.mapInArrow(index, "first long, buckets binary, v binary, ids array<long>").repartitionByRange(parts, "first", F.xxhash64("v")).sortWithinPartitions("first", "buckets")
    indexed = written(indexed.select("buckets", "v", "ids"), "vectors")
    asked = written(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).mapInArrow(ask, PLANS), "vector-queries")

    def one_pass(block: list, whole: bool) -> DataFrame:
        """What a block of queries finds; with ``whole`` they visit all buckets.  Rows
        without a vec_id have the number of products."""
        own = [r.query_id for r in block]
        q = _matrix(r.q for r in block)
        logs = np.stack([np.frombuffer(r.logs, np.float64).reshape(-1, TABLES, HASHES, CELLS) for r in block])
        floors = np.stack([np.frombuffer(r.floors, np.float64).reshape(-1, TABLES) for r in block])
        shared = spark.sparkContext.broadcast((own, q, logs, floors))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q, logs, floors = shared.value
            near, count, lengths = Nearest(len(own), k), np.zeros(len(own), np.int64), np.sqrt(np.einsum("ij,ij->i", q, q))
            for batch in batches:
                for at in range(0, batch.num_rows, TILE_ROWS):
                    part = batch.slice(at, TILE_ROWS)
                    found = np.stack([np.frombuffer(x, np.int64) for x in part.column(0).to_pylist()])
                    m, n = _scaled(_matrix(part.column(1).to_pylist()))
                    names = part.column(2).to_pylist()
                    for x in range(0, len(own), TILE_QUERIES):
                        tile = slice(x, x + TILE_QUERIES)
                        scores = np.full((len(lengths[tile]), len(m)), -np.inf)
                        visits = [(logs[tile, i], floors[tile, i]) for i in range(logs.shape[1])] + [None] * whole
                        for who, which, dots in products(q[tile], m, found, visits):
                            scores[np.ix_(who, which)] = dots / (lengths[tile][who, None] * n[which])
                            count[x + who] += len(which)
                        near.add(x, scores, names)
            rows_ = list(near.rows(own))
            rows_ += [(query, None, int(c)) for query, c in zip(own, count.tolist(), strict=True) if c]
            yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows_], "vec_id": [r[1] for r in rows_], "score": [float(r[2]) for r in rows_]}, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        return indexed.mapInArrow(meet, FOUND)

    def all_passes(planned: DataFrame, whole: bool, path: str) -> None:
        """Adds what the queries ``planned`` find to the table at ``path``."""
        wave: list[DataFrame] = []
        queue = planned.toLocalIterator()
        while block := list(itertools.islice(queue, query_block)):
            wave.append(one_pass(block, whole))
            if len(wave) == WAVE:
                functools.reduce(DataFrame.union, wave).write.mode("append").parquet(path)
                wave.clear()
        if wave:
            functools.reduce(DataFrame.union, wave).write.mode("append").parquet(path)

    path = new_path(spark, "nearest-parts")
    spark.createDataFrame([], FOUND).write.parquet(path)
    ranked_by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    schema = "query_id long, rank int, vec_id long, score double, candidates long"
    finished, left, temporary = [spark.createDataFrame([], schema)], asked, [indexed, asked]
    for radius in (*RADII, None):
        if radius:
            left = written(left.mapInArrow(plan(radius), PLANS), "vector-plans")
            temporary.append(left)
        all_passes(left, radius is None, path)
        near = spark.read.schema(FOUND).parquet(path).join(left.select("query_id").distinct(), "query_id", "left_semi")
        best = near.filter("vec_id IS NOT NULL").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = best.withColumn("rank", F.row_number().over(ranked_by)).filter(F.col("rank") <= k)
        counts = near.filter("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("candidates"))
        best = written(best.join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "candidates"), "nearest")
        temporary.append(best)
        if radius is None:
            finished.append(best)
            break
        # the k-th is as near as what was planned for, or the last time is there at all
        done = best.filter((F.col("rank") == k) & (F.col("score") >= (1 - radius**2 / 2 if radius != RADII[-1] else -2))).select("query_id")
        finished.append(best.join(done, "query_id", "left_semi"))
        left = written(left.join(done, "query_id", "left_anti").select("query_id", "q", "logs", "floors"), "vector-queries")
        temporary.append(left)
        if left.isEmpty():
            break
    found = written(functools.reduce(DataFrame.union, finished), "nearest")
    near.written_to = path
    dropped(*temporary, near)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all ``embeddings``."""
    return search(table(spark, sf_dir, "embeddings"))
