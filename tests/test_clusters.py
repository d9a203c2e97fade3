"""Clustering in rounds against the sequential definition."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.operators import clusters


def plain(rows, threshold):
    """canonical of each key, one after the other."""
    out, found = {}, {}
    for group, _, key, vector in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])):
        own = found.setdefault(group, [])
        close = [float(np.dot(v, vector)) for _, v in own]
        best = int(np.argmax(close)) if own else -1
        if own and close[best] >= threshold:
            out[key] = own[best][0]
        else:
            own.append((key, vector))
            out[key] = key
    return out


def near(rng, n, dim, centres, noise):
    middle = rng.normal(size=(centres, dim))
    v = middle[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def chain(n):
    """Each vector is within the threshold of the next one alone."""
    angle = np.arange(n) * 0.5
    v = np.zeros((n, 2 * n))
    for i in range(n):
        v[i, i], v[i, i + 1] = 0.7, 0.7
    return v + 0 * angle[:, None]


CASES = {
    "random": lambda rng: near(rng, 300, 8, 40, 0.25),
    "dense": lambda rng: near(rng, 300, 8, 2, 0.05),
    "far": lambda rng: near(rng, 200, 64, 200, 1.0),
    "chain": lambda rng: chain(40),
    "equal": lambda rng: np.repeat(near(rng, 5, 4, 5, 0.1), 30, axis=0),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("finish", [0, 10])
def test_rounds_are_greedy(spark, monkeypatch, name, finish):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(clusters, "TILE", 64)
    monkeypatch.setattr(clusters, "PRODUCT", 24)
    threshold = 0.48 if name == "chain" else 0.8
    vectors = CASES[name](rng)
    order = list(range(len(vectors)))
    if name != "chain" or finish:
        random.Random(3).shuffle(order)
    rows = [(["a", "b", None][k % 3] if k % 5 == 0 and name != "chain" else "a", o, f"n{k}", [float(x) for x in v]) for k, (o, v) in enumerate(zip(order, vectors, strict=True))]
    df = spark.createDataFrame(rows, "kind string, o int, name string, v array<double>")
    found = clusters.cluster(df, "kind", [F.col("o")], "name", "v", threshold, finish)
    assert found.columns == ["kind", "name", "canonical"]
    assert {r["name"]: r.canonical for r in found.collect()} == plain(rows, threshold)


def test_rounds_are_few_where_a_group_is_dense(spark):
    rng = np.random.default_rng(1)
    v = near(rng, 2000, 16, 3, 0.02)
    df = spark.createDataFrame([(0, 1999, i, [float(y) for y in x]) for i, x in enumerate(v)], "first long, last long, place long, vector array<double>")
    left: list[int] = []
    heads = clusters.founders(df, 0.9, 0, left.append)
    assert heads.count() == len(set(clusters.greedy_clusters(v, 0.9))) and left == [0]


def test_a_group_is_spread_over_tasks(spark, monkeypatch):
    """No task gets a group whole: a tile has two ranges of its rows, each once."""
    monkeypatch.setattr(clusters, "TILE", 100)
    rng = np.random.default_rng(2)
    rows = [(0, 999, i, [float(y) for y in x]) for i, x in enumerate(near(rng, 1000, 8, 300, 0.5))]
    df = spark.createDataFrame(rows, "first long, last long, place long, vector array<double>")
    found = clusters._before(df, df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan
    tiles = df.select("place", (F.col("place") / 100).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), (F.col("place") / 100).cast("int"))).alias("j")).groupBy("i", "j").count()
    assert tiles.count() == 55 and tiles.agg(F.max("count")).first()[0] == 100
    assert found.count() == 999


def test_no_rows(spark):
    df = spark.createDataFrame([], "kind string, name int, vector array<double>")
    assert clusters.cluster(df, "kind", [F.col("name")], "name").count() == 0
