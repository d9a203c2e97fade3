"""Nearest neighbours, the n-gram join and the pipeline against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import ann_search, ngram_join

from .test_text import plain_secrets

V = [f"w{i}" for i in range(400)]


def families(rng):
    texts = []
    for n, size, edits in ((20, 60, 4), (60, 200, 12), (15, 7, 1), (10, 4, 2), (20, 30, 3)):
        base = rng.choices(V, k=size)
        for _ in range(n):
            own = base[:]
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(size)] = rng.choice(V)
            if rng.random() < 0.3:
                own = own[: int(size * rng.uniform(0.6, 1))]
            texts.append(" ".join(own))
    texts += ["", "a", "A b", "a B", "\t\n", "É x", "é x"]
    rng.shuffle(texts)
    return texts


def plain(texts):
    """Set sizes, and the least place that links reach."""
    sets = []
    for t in texts:
        words = t.translate({c: c + 32 for c in range(65, 91)}).split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("shingles, hot, flush", [(4 << 20, 1 << 16, 4 << 20), (2000, 3, 3000), (600, 10, 50)])
def test_components(spark, monkeypatch, shingles, hot, flush):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", shingles)  # the lesser ones deal groups out in blocks
    monkeypatch.setattr(ngram_join, "HOT_SETS", hot)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    texts = families(random.Random(3))
    sizes, roots = plain(texts)
    docs = spark.createDataFrame([(3 * i + 1, t, "x", 1) for i, t in enumerate(texts)] + [(None, "x y", "x", 1), (None, None, "x", 1)], "doc_id long, text string, name string, n int").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert {d: x for d, x in found.items() if d is not None} == {3 * i + 1: (n, 3 * r + 1) for i, (n, r) in enumerate(zip(sizes, roots, strict=True))}
    assert found[None][1] is None


def test_repeated_ids_and_empty_tables(spark):
    a, b, c = (" ".join(V[i : i + 40]) for i in (0, 50, 100))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b + " zz"), (3, c), (4, c), (9, "q w e r t y u")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0


def test_forest_is_whole():
    rng = np.random.default_rng(4)
    base = rng.choice(2**60, 300, replace=False).astype(np.uint64)
    sets = [np.sort(rng.choice(base, rng.integers(200, 300), replace=False)) for _ in range(60)] + [np.sort(base), base[:0]]
    top = list(range(len(sets)))

    def root(t, i):
        while t[i] != i:
            i = t[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.links(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j]))):
                top[root(top, i)] = root(top, j)
    own = list(range(len(sets)))
    for i, j in ngram_join.forest(sets):
        own[root(own, i)] = root(own, j)
    group = lambda t: sorted(map(sorted, {r: [i for i in range(len(sets)) if root(t, i) == r] for r in (root(t, i) for i in range(len(sets)))}.values()))
    assert group(own) == group(top)


def test_nearest(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    m = np.stack(frame.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = frame.vec_id.to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    scores = m[asked] @ m.T
    scores[np.arange(len(asked)), asked] = -9
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    wanted = {(ids[a], ids[b]) for a, row in zip(asked, best, strict=True) for b in row}
    found = ann_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_block=4).toPandas()
    assert found.candidates.max() <= len(ids) and found.candidates.mean() < 0.8 * len(ids)
    assert len({(r.query_id, r.vec_id) for r in found.itertuples()} & wanted) >= 0.9 * len(wanted)
    at = {x: i for i, x in enumerate(ids)}
    for r in found.itertuples():
        assert r.score == pytest.approx(m[at[r.query_id]] @ m[at[r.vec_id]], abs=1e-12)
    assert found.groupby("query_id")["rank"].apply(sorted).tolist() == [[1, 2, 3, 4, 5]] * len(asked)


def test_nearest_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v), (3, v), (2, v), (1, v), (4, [2.0, 4.0]), (50, [2.0, -1.0]), (51, None), (52, [0.0, 0.0]), (53, [1.0, None]), (54, [1.0, float("nan")]), (55, [float("inf"), 1.0]), (56, [1.0]), (None, v), (0, v), (100, None)]
    df = spark.createDataFrame([(i, x, "q") for i, x in rows], "vec_id long, embedding array<float>, query_id string")
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann_search.search(df).orderBy("query_id", "rank").collect()]
    assert found[:5] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 4, 1.0), (0, 5, 50, 0.0)]
    assert [f[:3] for f in found[5:]] == [(50, k + 1, k) for k in range(5)]
    assert ann_search.search(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(50, [1e300, 2e300]), (1, [1e-300, 2e-300]), (2, [1.0, 2.0]), (3, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 9)) for r in ann_search.search(huge).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (3, round(1 / 10**0.5, 9))]


def test_nearest_of_clusters(spark):
    """Queries with near neighbours take few products."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    m = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 64)) * 0.03
    found = ann_search.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>")).toPandas()
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = np.arange(0, 2000, 50)
    scores = m[asked] @ m.T
    scores[np.arange(len(asked)), asked] = -9
    wanted = {(50 * a, b) for a, row in enumerate(np.argsort(-scores, axis=1, kind="stable")[:, :5].tolist()) for b in row}
    assert len({(r.query_id, r.vec_id) for r in found.itertuples()} & wanted) >= 0.95 * len(wanted)
    assert found.candidates.mean() < 0.2 * len(m)


def test_products_are_of_visited_pairs():
    rng = np.random.default_rng(2)
    m = np.repeat(rng.normal(size=(150, 16)), 2, axis=0) + rng.normal(size=(300, 16)) * 0.001
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found, q = ann_search.buckets(m), m[::7]
    near, far = ann_search.plans(q, 0.45), ann_search.plans(q, 1.22)
    first, then = ann_search.visited(found, *near), ann_search.visited(found, *far)
    for visits, mask in [([near], first), ([near, far], then & ~first), ([near, far, None], ~then & ~first)]:
        done = np.zeros(mask.shape, int)
        for who, rows, dots in ann_search.products(q, m, found, visits):
            done[np.ix_(who, rows)] += 1
            assert dots.shape == (len(who), len(rows)) and np.allclose(dots, q[who] @ m[rows].T)
        assert (done == mask).all()  # each visited pair once, no other at all


def test_visits_by_definition():
    """A query's buckets in falling order of their estimate, up to the share."""
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(300, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    logs, floors = ann_search.plans(unit[:5])
    found = ann_search.buckets(unit)
    mask = ann_search.visited(found, logs, floors)
    share = 1 - (1 - ann_search.SUCCESS) ** (1 / ann_search.TABLES)
    for i in range(5):
        wanted = np.zeros(len(unit), bool)
        for t in range(ann_search.TABLES):
            codes = np.arange(ann_search.CELLS**ann_search.HASHES)
            p = np.exp(sum(logs[i, t, k, codes // ann_search.CELLS**k % ann_search.CELLS] for k in range(ann_search.HASHES)))
            order = np.argsort(-p, kind="stable")
            n = int(np.searchsorted(np.cumsum(p[order]), share)) + 1
            # the share is measured in steps, so a little more may be visited
            assert n <= (p >= np.exp(floors[i, t])).sum() <= n * 1.1 + 5
            wanted |= np.isin(found[:, t], order[:n])
        assert mask[i][wanted].all() and mask[i].sum() <= wanted.sum() * 1.1 + 5


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quirelake.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "test")
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns and docs.count() <= before.count()
    # each stage's whole result by a plain version
    before, after = (x.toPandas() for x in seen["language ID"])
    lettered = before.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert sorted(after.doc_id) == sorted(before.doc_id[lettered]) and dict(zip(after.doc_id, after.text, strict=True)) == dict(zip(before.doc_id[lettered], before.text[lettered], strict=True))
    before, after = (x.toPandas() for x in seen["line dedup"])
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = Counter(k for t in before.text for k in {key(x) for x in t.split("\n")} if k)
    wanted = {d: "\n".join(x for x in t.split("\n") if not key(x) or holders[key(x)] < 10) for d, t in zip(before.doc_id, before.text, strict=True)}
    assert dict(zip(after.doc_id, after.text, strict=True)) == wanted and (after.n_chars == after.text.str.len()).all()
    before, after = (x.toPandas() for x in seen["secret scans"])
    owners, found = {}, {}
    for d, s, t in zip(before.doc_id, before.source, before.text, strict=True):
        found[d] = plain_secrets(t)
        for x in found[d]:
            owners.setdefault(x[3], set()).add((s, d))
    shared = {v for v, x in owners.items() if len({s for s, _ in x}) >= 3 or len({s for s, _ in x}) > 1 and len(x) >= 10}
    for d, t in zip(before.doc_id, before.text, strict=True):
        out, at = "", 0
        for start, end in sorted({(e - len(v), e) for _, _, e, v in found[d] if v not in shared}):
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        wanted[d] = out + t[at:]
    assert dict(zip(after.doc_id, after.text, strict=True)) == {d: wanted[d] for d in before.doc_id}
    before, after = (x.toPandas() for x in seen["n-gram Jaccard join"])
    _, roots = plain(before.sort_values("doc_id").text.fillna("").tolist())
    ids = before.sort_values("doc_id").doc_id.tolist()
    assert sorted(after.doc_id) == sorted({ids[r] for r in roots})
    before, after = (x.toPandas() for x in seen["packing"])
    assert set(after.doc_id) == set(before.doc_id)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "Only words here, and more words.", None, "s", 3)], table(spark, sf_dir, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = written(stage(spark, odd, sf_dir), "odd")
    assert odd.columns[0] == "doc_id"


def test_pipeline_keeps_clean_text(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    words = {r.lang: " ".join(r.text.split()[:60]) for r in docs.filter("length(text) > 800").dropDuplicates(["lang"]).collect()}
    mixed = " ".join(words[x] for x in ("de", "en", "es", "fr"))
    more = [(-1, mixed, None), (-2, "Привет мир и всё остальное", "ru"), (-3, "Привет мир", None), (-4, "12 !?", "en"), (-5, None, "en")]
    odd = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in more], docs.schema)
    found = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.unionByName(odd), sf_dir).filter("doc_id < 0").collect()}
    assert found.keys() == {-1, -2, -3} and found[-1] in words and found[-2] == "ru"
    bare = corpus_pipeline.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), sf_dir)
    assert {r.doc_id: r.lang for r in bare.collect()} == {-1: None, -2: None, -3: None}
