"""The stored vector index against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators import vector_index as VI
from quirelake.schema import GraphError


def clustered(n=4000, dim=16, centres=60, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def frame(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], "key long, vector array<float>")


def brute(m, q, k):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    close = unit(m.astype(np.float64)) @ unit(np.asarray(q, np.float64))
    return np.lexsort((np.arange(len(m)), -close))[:k].tolist()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    m = clustered()
    path = str(tmp_path_factory.mktemp("index"))
    odd = spark.createDataFrame([(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [None] + [1.0] * 15)], "key long, vector array<float>")
    return m, VI.write(frame(spark, m).unionByName(odd), path, cells=64)


def test_recall_and_share_of_rows(spark, made):
    m, index = made
    assert index.rows.sum() == len(m) and index.vectors.count() == len(m)
    hits = read = 0
    for i in range(0, 400, 40):
        q = m[i].tolist()
        cells = VI.probed(index, q, 6)
        read += index.rows[np.isin(index.cells, cells)].sum()
        hits += len(set(brute(m, q, 10)) & {r.key for r in VI.search(index, q, 10, probes=6).collect()})
    assert hits / 100 >= 0.9 and read / (10 * len(m)) < 0.25


def test_probes_are_partition_filters(made):
    m, index = made
    q = m[0].tolist()
    plan = VI.search(index, q, 5, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    files = {r[0].split("cell=")[1].split("/")[0] for r in index.vectors.filter(F.col("cell").isin([int(c) for c in VI.probed(index, q, 3)])).select("_metadata.file_path").distinct().collect()}
    assert files == {str(c) for c in VI.probed(index, q, 3)}


def test_exact_search_reads_what_it_needs(made):
    m, index = made
    rng = np.random.default_rng(9)
    for q in [m[17].tolist(), *rng.normal(size=(3, 16)).tolist()]:
        found = VI.search(index, q, 7, probes=1, exact=True).collect()
        assert [r.key for r in found] == brute(m, q, 7)
    near = VI.search(index, m[17].tolist(), 7, probes=1, exact=True).collect()
    assert len(VI.may_reach(index, m[17].tolist(), near[-1].score)) < len(index.cells) / 2
    assert VI.search(index, m[0].tolist(), 5000, probes=1, exact=True).count() == len(m)


def test_all_queries(spark, made, monkeypatch):
    m, index = made
    monkeypatch.setattr(VI, "PART_ROWS", 40)
    found: dict[int, list[int]] = {}
    for r in VI.search_all(index, frame(spark, m[:30]).withColumnRenamed("key", "query_id"), 10, probes=64).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.key)
    assert found == {i: brute(m, m[i], 10) for i in range(30)}
    some = VI.search_all(index, frame(spark, m[:200]).withColumnRenamed("key", "query_id"), 10, probes=6).collect()
    hits = sum(r.key in set(brute(m, m[r.query_id], 10)) for r in some)
    assert len(some) == 2000 and hits / 2000 >= 0.9


def test_added_vectors_are_found(spark, tmp_path):
    m = clustered(600)
    index = VI.write(frame(spark, m[:500]), str(tmp_path), cells=10)
    before = index.vectors.inputFiles()
    wide = np.full((1, 16), -3.0, np.float32)
    index = VI.add(index, frame(spark, np.concatenate([m[500:], wide]), 500))
    assert set(before) < set(index.vectors.inputFiles()) and index.rows.sum() == 601
    whole = np.concatenate([m, wide])
    for i in (3, 555, 600):
        assert [r.key for r in VI.search(index, whole[i].tolist(), 5, probes=1, exact=True).collect()] == brute(whole, whole[i], 5)


def test_errors(spark, made, tmp_path):
    _, index = made
    for call, code in ((lambda: VI.search(index, [1.0]), "INVALID_EMBEDDING_DIMENSION"), (lambda: VI.search(index, [0.0] * 16), "INVALID_EMBEDDING"), (lambda: VI.read(spark, f"{tmp_path}/none"), "NO_INDEX"), (lambda: VI.write(frame(spark, []), str(tmp_path)), "EMPTY_INDEX")):
        with pytest.raises(GraphError) as e:
            call()
        assert e.value.code == code
    one = VI.write(frame(spark, clustered(1)), f"{tmp_path}/one")
    assert VI.search(one, clustered(1)[0].tolist(), 5).count() == 1
