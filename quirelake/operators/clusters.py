"""Greedy clustering of ordered vectors, in rounds over all tasks.

One after the other, a vector joins the most similar founder so far if that reaches the
threshold (ties to the earliest), else it founds a cluster.  So a vector is a founder if
no earlier founder of its group is within the threshold, which rounds decide in
parallel: undecided vectors without an earlier undecided neighbour are founders, and
their neighbours aren't.  Vectors meet in tiles, each a matrix product in one task that
returns a row for each vector at most; pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written
from ..sources.metadata import numbered

THRESHOLD = 0.85
#: Vectors of one side of a tile; a tile copies each of them once.
TILE = 16_384
#: Rows and columns of one matrix product within a tile.
PRODUCT = 2_048
#: Vectors that one task may decide one after the other, after the first round.
FINISH = 4_096


def greedy_clusters(vectors: np.ndarray, threshold: float = THRESHOLD, block: int = 1024) -> list[int]:
    """For each vector in turn, the place of the founder it joins: the most similar
    one so far if that reaches the threshold (ties to the earliest), else itself.

    Blocks of vectors are compared with all founders before them at once, and with the
    founders of their own block one after the other.
    """
    founders = np.empty_like(vectors)
    places: list[int] = []
    out: list[int] = []
    for start in range(0, len(vectors), block):
        own = vectors[start : start + block]
        best, score = np.full(len(own), -1), np.full(len(own), -np.inf)
        if places:
            close = own @ founders[: len(places)].T
            best = close.argmax(axis=1)
            score = close[np.arange(len(own)), best]
        among = own @ own.T
        new: list[int] = []  # of this block, by their places in it
        for i in range(len(own)):
            at, top = int(best[i]), float(score[i])
            if new:
                k = int(among[i, new].argmax())
                if among[i, new[k]] > top:
                    at, top = -2 - new[k], float(among[i, new[k]])
            if top >= threshold:
                out.append(places[at] if at >= 0 else start - 2 - at)
                continue
            new.append(i)
            out.append(start + i)
        founders[len(places) : len(places) + len(new)] = own[new]
        places += [start + i for i in new]
    return out


def _matrix(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part["vector"]).astype(np.float64)


def _nearest_before(late: pd.DataFrame, early: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``late``, the largest product with a row of ``early`` of its
    group that comes before it, and that row's place; -inf without one."""
    early = early.sort_values("place")
    a, b = _matrix(late), _matrix(early)
    groups, places = (x.to_numpy() for x in (early["first"], early["place"]))
    score, found = np.full(len(a), -np.inf), np.full(len(a), -1, np.int64)
    for i in range(0, len(a), PRODUCT):
        rows = slice(i, i + PRODUCT)
        own_group, own_place = late["first"].to_numpy()[rows], late["place"].to_numpy()[rows]
        for j in range(0, len(b), PRODUCT):
            columns = slice(j, j + PRODUCT)
            close = a[rows] @ b[columns].T
            close[(own_group[:, None] != groups[columns]) | (places[columns] >= own_place[:, None])] = -np.inf
            best = close.argmax(axis=1)  # the earliest of equals
            top = close[np.arange(len(close)), best]
            better = top > score[rows]
            score[rows][better], found[rows][better] = top[better], places[columns][best][better]
    return score, found


def _before(late: DataFrame, early: DataFrame, threshold: float | None = None) -> DataFrame:
    """(place, score, founder) of the rows of ``late`` (first, last, place, vector) that
    have a row of ``early`` before them in their group, one that reaches ``threshold``
    if that is given: the nearest one.  ``first`` names a group by its first place.

    Rows meet in tiles of two ranges of places.  A group's ranges are next to each
    other, so a tile has one group, but at its ends.
    """
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    a = late.select("first", "place", "vector", tile("place").alias("i"), F.explode(F.sequence(tile("first"), tile("place"))).alias("j"))
    # names of their own, as both sides may come from one table
    b = early.select(F.col("first").alias("f"), F.col("place").alias("p"), F.col("vector").alias("v"), F.explode(F.sequence(tile("place"), tile("last"))).alias("x"), tile("place").alias("y"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"place": [], "score": [], "founder": []})
        score, found = _nearest_before(x, y.rename(columns={"f": "first", "p": "place", "v": "vector"}))
        has = score >= threshold if threshold is not None else found >= 0
        return pd.DataFrame({"place": x["place"].to_numpy()[has], "score": score[has], "founder": found[has]})

    met = a.groupBy("i", "j").cogroup(b.groupBy("x", "y")).applyInPandas(meet, "place long, score double, founder long")
    best = met.groupBy("place").agg(F.max_by("founder", F.struct(F.col("score"), -F.col("founder"))).alias("founder"), F.max("score").alias("score"))
    return best.select("place", "score", "founder")


def _finish(left: DataFrame, threshold: float) -> DataFrame:
    """(place) of the founders among undecided rows, group by group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        found = np.array(greedy_clusters(_matrix(part), threshold))
        return pd.DataFrame({"place": part["place"].to_numpy()[found == np.arange(len(found))]})

    return left.select("first", "place", "vector").groupBy("first").applyInPandas(run, "place long")


def founders(rows: DataFrame, threshold: float = THRESHOLD, finish: int = FINISH, log: Callable[[int], None] | None = None) -> DataFrame:
    """(place) of the founders among ``rows`` (first, last, place, vector), written.

    A round needs each undecided row's neighbours among those before it alone, and then
    the neighbours of the new founders.  Where at most ``finish`` rows are left after a
    round, one task decides them; a group that is similar all over is one round.
    """
    left, made, spare = rows, [], []
    while True:
        behind = written(_before(left, left, threshold).select("place"), "cluster-behind")
        made.append(written(left.join(behind, "place", "left_anti").select("place"), "founders"))
        rest = left.join(behind, "place", "left_semi")
        new = left.join(made[-1], "place", "left_semi")
        near = _before(rest, new, threshold).select("place")
        undecided = written(rest.join(near, "place", "left_anti").select(*rows.columns), "undecided")
        dropped(behind, *spare)
        left, spare = undecided, [undecided]
        n = undecided.count()
        if log:
            log(n)
        if n <= finish:
            break
    if n:
        made.append(written(_finish(left, threshold), "founders"))
    dropped(*spare)
    if len(made) == 1:
        return made[0]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    out = written(out, "all-founders")
    dropped(*made)
    return out


def cluster(rows: DataFrame, group: str, order: list[Column], key: str, vector: str = "vector", threshold: float = THRESHOLD, finish: int = FINISH) -> DataFrame:
    """(group, key, canonical): greedy clustering within each group in the given order.

    Rows of equal group and order are in no defined order, so ``order`` should end with
    a unique column.  A null group is one of its own.
    """
    by = [f"__o{i}" for i in range(len(order))]
    named = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("vector"), *(o.alias(b) for o, b in zip(order, by, strict=True)))
    ordered = numbered(named, "g", *by)
    placed = written(ordered.drop(*by), "ordered-names")
    dropped(ordered)
    ends = placed.groupBy("g").agg(F.min("place").alias("first"), F.max("place").alias("last")).withColumnRenamed("g", "__g")
    whole = written(placed.join(ends, F.col("g").eqNullSafe(F.col("__g"))).select("g", "k", "vector", "first", "last", "place"), "cluster-names")
    own = whole.select("first", "last", "place", "vector")
    heads = founders(own, threshold, finish)
    head = own.join(heads, "place", "left_semi")
    joined = _before(own.join(heads, "place", "left_anti"), head).select("place", "founder")
    to = joined.unionByName(heads.select("place", F.col("place").alias("founder")))
    names = whole.select(F.col("place").alias("founder"), F.col("k").alias("canonical"))
    out = written(whole.select("g", "k", "place").join(to, "place").join(names, "founder").select(F.col("g").alias(group), F.col("k").alias(key), "canonical"), "clusters")
    dropped(placed, whole, heads)
    return out
