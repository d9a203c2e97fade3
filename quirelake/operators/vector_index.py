"""A stored vector index: vectors written by cells of a k-means.

The cells are fitted on a sample of at most ``SAMPLE`` vectors; every vector is written
to the folder of its nearest centroid, with the cell as a partition column, so a search
reads the folders of the cells it probes and no others.  A cell's radius, the largest
angle between its centroid and a vector of it, bounds how near its vectors can be to a
query: with ``exact`` a search reads just the cells that could hold one of the nearest.

Vectors null, zero, or with null or non-finite components aren't indexed, as they have
no cosine.  The index is a copy: ``write`` makes it anew, ``add`` puts vectors in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import GraphError
from ..scratch import dropped, written

#: Vectors that cells are fitted on, in expectation, and cells at most.
SAMPLE = 100_000
MOST_CELLS = 16_384
#: Rows of one file of a cell; a larger cell is written by several tasks.
CELL_ROWS = 1_000_000
#: Rows of a cell that meet its queries in one task.
PART_ROWS = 50_000
PROBES = 8


def usable(vector: Column | str) -> Column:
    """Whether a vector has a cosine."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


@dataclass
class VectorIndex:
    """What is below ``path``; the centroids are in memory (``MOST_CELLS`` at most)."""

    spark: SparkSession
    path: str
    cells: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    @property
    def vectors(self) -> DataFrame:
        """(key, vector, cell) of all indexed vectors."""
        return self.spark.read.parquet(f"{self.path}/vectors")


def _assigner(centroids: np.ndarray):
    """Adds each vector's cell and the angle to its centroid."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = np.stack(part["vector"]).astype(np.float64) if len(part) else np.zeros((0, centroids.shape[1]))
            close = (m @ centroids.T) / np.linalg.norm(m, axis=1, keepdims=True)
            cell = close.argmax(axis=1) if len(part) else np.zeros(0, int)
            angle = np.arccos(np.clip(close[np.arange(len(m)), cell], -1, 1))
            yield part.assign(cell=cell.astype(np.int32), angle=angle)

    return run


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    key = vectors.schema["key"].dataType.simpleString()
    good = vectors.select("key", F.col("vector").cast("array<float>").alias("vector")).filter(usable("vector"))
    return written(good.mapInPandas(_assigner(centroids), f"key {key}, vector array<float>, cell int, angle double"), "cells")


def _sizes(assigned: DataFrame) -> DataFrame:
    """(cell, n, radius) of assigned vectors: ``MOST_CELLS`` rows at most."""
    return assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))


def _put(assigned: DataFrame, sizes: DataFrame, path: str, mode: str) -> None:
    """Writes assigned vectors by cell."""
    files = F.floor((F.col("n") - 1) / CELL_ROWS) + 1
    dealt = assigned.join(F.broadcast(sizes.select("cell", files.alias("files"))), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("files")))
    dealt.repartition("cell", "part").sortWithinPartitions("cell").select("key", "vector", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def _put_centroids(spark: SparkSession, rows: list[tuple], path: str, version: int) -> None:
    spark.createDataFrame(rows, "cell int, centroid array<double>, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids/v={version}")


def write(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 15, seed: int = 1) -> VectorIndex:
    """An index of ``vectors`` (key, vector) below ``path``; about the square root of
    their number of ``cells`` unless that is given."""
    spark = vectors.sparkSession
    good = vectors.filter(usable("vector"))
    n = good.count()
    if not n:
        raise GraphError("EMPTY_INDEX", "there is no vector to index")
    cells = min(cells or math.isqrt(n) + 1, MOST_CELLS, n)
    chosen = good if n <= sample else good.filter(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)) < sample)
    rows = chosen.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    if cells == 1:
        first = good.select("vector").first()[0]
        centroids = np.array([first], np.float64)
    else:
        centroids = np.array(KMeans(k=cells, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows).clusterCenters())
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
    assigned = _assigned(vectors, centroids)
    sizes = _sizes(assigned)
    known = {r.cell: (r.n, r.radius) for r in sizes.collect()}
    _put(assigned, sizes, path, "overwrite")
    _put_centroids(spark, [(i, [float(x) for x in c], *known.get(i, (0, 0.0))) for i, c in enumerate(centroids)], path, 0)
    dropped(assigned)
    return read(spark, path)


def add(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """``index`` with more ``vectors`` (key, vector), by the cells that there are.  Keys
    must be new: nothing that is stored is read.  The wider radii are written before the
    vectors, so an exact search is right if this ends in between."""
    assigned = _assigned(vectors, index.centroids)
    found = _sizes(assigned)
    sizes = {r.cell: (r.n, r.radius) for r in found.collect()}
    table = []
    for cell, centroid, n, radius in zip(index.cells.tolist(), index.centroids.tolist(), index.rows.tolist(), index.radii.tolist(), strict=True):
        more, wide = sizes.get(cell, (0, 0.0))
        table.append((cell, centroid, n + more, max(radius, wide)))
    _put_centroids(index.spark, table, index.path, _version(index.spark, index.path) + 1)
    _put(assigned, found, index.path, "append")
    dropped(assigned)
    return read(index.spark, index.path)


def _version(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centroids")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise GraphError("NO_INDEX", path)
    done = [s.getPath() for s in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(int(p.getName()[2:]) for p in done)


def read(spark: SparkSession, path: str) -> VectorIndex:
    """The index below ``path``."""
    rows = spark.read.parquet(f"{path}/centroids/v={_version(spark, path)}").orderBy("cell").collect()  # MOST_CELLS at most
    column = lambda c: np.array([r[c] for r in rows])
    return VectorIndex(spark, path, column("cell"), column("centroid"), column("radius"), column("n"))


def _scored(index: VectorIndex, cells: Sequence[int], query: Sequence[float]) -> DataFrame:
    own = V.literal(query)
    return index.vectors.filter(F.col("cell").isin([int(c) for c in cells])).select("key", V.cosine_score("vector", own).alias("score"))


def probed(index: VectorIndex, query: Sequence[float], probes: int = PROBES) -> np.ndarray:
    """The cells that hold vectors, of which the ``probes`` nearest to the query."""
    if len(query) != index.centroids.shape[1]:
        raise GraphError("INVALID_EMBEDDING_DIMENSION", str(len(query)))
    q = np.asarray(query, np.float64)
    if not np.isfinite(q).all() or not q.any():
        raise GraphError("INVALID_EMBEDDING", "a query needs a direction")
    close = index.centroids @ (q / np.linalg.norm(q))
    order = np.lexsort((index.cells, -close))
    return index.cells[order][index.rows[order] > 0][:probes]


def may_reach(index: VectorIndex, query: Sequence[float], score: float) -> np.ndarray:
    """The cells that could hold a vector with that score (0 to 1) or a better one."""
    q = np.asarray(query, np.float64)
    angle = np.arccos(np.clip(index.centroids @ (q / np.linalg.norm(q)), -1, 1))
    best = (1 + np.cos(np.maximum(0, angle - index.radii))) / 2
    return index.cells[(index.rows > 0) & (best >= score - 1e-6)]  # vectors are floats


def search(index: VectorIndex, query: Sequence[float], top_k: int = 5, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(key, score) of the nearest vectors, by cosine on a scale from 0 to 1, ties to
    the smaller key: those of the nearest ``probes`` cells, or with ``exact`` of all
    cells that could have one, which the nearest ones tell."""
    near = probed(index, query, probes)
    if exact:
        found = _scored(index, near, query).orderBy(F.desc("score"), "key").limit(top_k).collect()
        rest = index.cells[index.rows > 0] if len(found) < top_k else may_reach(index, query, found[-1].score)
        near = np.union1d(near, rest)
    return _scored(index, near, query).orderBy(F.desc("score"), "key").limit(top_k)


def search_all(index: VectorIndex, queries: DataFrame, top_k: int = 10, probes: int = PROBES) -> DataFrame:
    """(query_id, key, score, rank) of the ``top_k`` nearest of each of ``queries``
    (query_id, vector) in its nearest ``probes`` cells.

    Queries go to their cells, not vectors to queries; a cell's rows come in parts of
    ``CELL_ROWS`` at most, each of which keeps the best of its own.
    """
    centroids, cells, has = index.centroids, index.cells, index.rows > 0

    def chosen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = np.stack(part["vector"]).astype(np.float64) if len(part) else np.zeros((0, centroids.shape[1]))
            close = np.where(has, m @ centroids.T, -np.inf)
            top = np.argsort(-close, axis=1, kind="stable")[:, : min(probes, int(has.sum()))]
            yield part.assign(cell=[cells[t].tolist() for t in top])

    def meet(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({"query_id": [], "key": [], "score": []})
        own = own.sort_values("key")
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        score = (1 + unit(np.stack(asked["q"]).astype(np.float64)) @ unit(np.stack(own["vector"]).astype(np.float64)).T) / 2
        top = np.argsort(-score, axis=1, kind="stable")[:, :top_k]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), top.shape[1]), "key": own["key"].to_numpy()[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

    kinds = {c: t for c, t in queries.dtypes}
    key = index.vectors.schema["key"].dataType.simpleString()
    good = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(usable("vector"))
    asked = good.mapInPandas(chosen, f"query_id {kinds['query_id']}, vector array<float>, cell array<int>").select("query_id", F.col("vector").alias("q"), F.explode("cell").alias("c"))
    sizes = index.spark.createDataFrame([(int(c), int((n - 1) // PART_ROWS)) for c, n in zip(index.cells, index.rows, strict=True) if n], "cell int, last int")
    sizes = F.broadcast(sizes)  # a row for each cell
    own = index.vectors.join(sizes, "cell").select("key", "vector", "cell", F.pmod(F.xxhash64("key"), F.col("last") + 1).cast("int").alias("part"))
    asked = asked.join(sizes, F.col("c") == F.col("cell")).select("query_id", "q", "c", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("p"))
    met = asked.groupBy("c", "p").cogroup(own.groupBy("cell", "part")).applyInPandas(meet, f"query_id {kinds['query_id']}, key {key}, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "key"))), 1, top_k)
    return met.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", "b.key", (-F.col("b.s")).alias("score"), (F.col("i") + 1).alias("rank"))
