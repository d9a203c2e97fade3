"""Token alignment, source mixing and the conversation trie against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import mixing, prefix_trie, running, token_alignment

NAMES = (token_alignment.BYTE_BPE, token_alignment.PIECE_BPE)


@pytest.mark.parametrize(("parts", "batch"), [("1", "10000"), ("7", "3")])
def test_running_sums(spark, parts, batch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.choice([None, 1, 5, -2])) for i in range(400)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "g string, i int, v long").withColumn("w", F.lit(3).cast("long"))
        found = {r.i: (r.v_before, r.w_before) for r in running.running(df, ["g"], [F.col("i").desc()], ["v", "w"], {"w": 7}).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for g, i, _ in rows:
        before = [v or 0 for h, j, v in rows if h == g and j > i]
        assert found[i] == (sum(before), 3 * len(before) % 7)


def test_running_sums_without_rows(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert running.running(df, ["g"], [F.col("v").asc()], ["v"]).count() == 0


def plain_mix(rows, weights=(5, 2, 1)):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target: dict = {}
    left = sum(own.values())
    while True:
        free = [s for s in sources if s not in target]
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * own[s]
            left -= target[s]
    out = []
    for s in sources:
        budget, before = int(target[s] + 0.5), 0
        mine = sorted((int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16), n, i is not None, i or 0) for n, (i, _, x) in zip(sizes, rows, strict=True) if x == s)
        for _, n, known, i in mine:
            rest = budget % own[s] - before if own[s] else 0
            out.append((i if known else None, n, own[s], round(float(target[s]), 6), budget // own[s] * n + max(0, min(n, rest)) if own[s] else 0))
            before += n
    return sorted(out, key=str)


@pytest.mark.parametrize("sources", [1, 2, 5])
def test_mix(spark, odd_docs, sources):
    rng = random.Random(sources)
    rows = [(i if i % 40 else 40, " ".join(["w"] * rng.randrange(30)) if i % 7 else None, rng.choice(["é", "z", "", None, "A"][:sources]) if i > 200 else "z") for i in range(600)]
    rows += [(1000 + i, "one two", "tiny") for i in range(3)] + [(2000, " \n", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    columns = ("doc_id", "size", "source_size", "target", "taken")
    found = [tuple(round(r[c], 6) if c == "target" else r[c] for c in columns) for r in mixing.mix(df.withColumn("size", F.lit("x"))).select(*columns).collect()]
    assert sorted(found, key=str) == plain_mix(rows)
    odd = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    again = [tuple(round(r[c], 6) if c == "target" else r[c] for c in columns) for r in mixing.mix(odd_docs).select(*columns).collect()]
    assert sorted(again, key=str) == plain_mix(odd)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_by_given_weights(spark):
    df = spark.createDataFrame([(i, "a b c d", "x" if i % 4 else "y") for i in range(40)], "doc_id long, text string, source string")
    taken = {r.source: (r.t, r.most) for r in mixing.mix(df, {"y": 1.0}, share=0.5).groupBy("source").agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()}
    assert taken == {"x": (0, 0.0), "y": (80, 2.0)}


def plain_trie(conversations):
    """Nodes by definition from {conv_id: [(role, text), ...]}."""
    members, last = defaultdict(list), {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        last[c] = tuple(turns)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        children = sum(len(x) == len(node) + 1 for x in below)
        ends = ",".join(map(str, sorted(c for c in own if last[c] == node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own[c].append((role or "", text or ""))
    kept = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: kept[c]] + turns[kept[c] :] for c, turns in own.items()}


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for c in range(120):
        if c % 11 == 5:
            continue
        start = rng.choice([0, 0, 0, c])
        rows += [(c, None if t == 0 else t, [None, "user", "assistant"][t % 3], None if t == 4 else f"é{start} {t}" if t < 3 else f"{c % 4} {t}") for t in range(rng.choice([1, 2, 5, 12]))]
    return [*rows, (None, 1, "user", "lost"), (400, 1, "user", "long " * 30_000), *((401, i, "user", "x") for i in range(300))]


@pytest.mark.parametrize("primes", [prefix_trie.PRIMES, (101, 3)])
def test_trie(spark, primes, monkeypatch):
    """Small primes make fingerprints collide, so groups are split."""
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rounds = []
    real = prefix_trie.fingerprints
    monkeypatch.setattr(prefix_trie, "fingerprints", lambda *a: rounds.append(1) or real(*a))
    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    turns = prefix_trie.numbered(df)
    made, convs = prefix_trie.rebuilt(turns)
    found = prefix_trie.trie(made, convs, primes)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == plain_trie(plain_rebuilt(rows))
    assert len(rounds) == 1 if primes == prefix_trie.PRIMES else len(rounds) > 1


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "v", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = {1: [("u", "a"), ("u", "b")], 2: [("u", "a"), ("u", "a")], 3: [("v", "a")]}
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in prefix_trie.conversation_trie(df).collect()), key=str) == plain_trie(plain)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, by
    comparing byte ranges."""
    sides = [token_alignment._side(n) for n in NAMES]
    docs = []
    for text in texts:
        pair = token_alignment.tokens_of([text or ""], NAMES)[0]
        ends = [list(itertools.accumulate(len(s.bytes[i]) for i in ids)) for s, ids in zip(sides, pair, strict=True)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(pair[0][i], pair[1][j]) for i in range(len(pair[0])) for j in range(len(pair[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        inside = lambda k, low, high: ",".join(str(x) for x, e in zip(pair[k], ends[k], strict=True) if low < e <= high)  # noqa: E731,B023
        groups = ";".join(f"{inside(0, low, high)}|{inside(1, low, high)}" for low, high in zip([0, *cuts], cuts, strict=False))
        docs.append((pair, cuts, links, groups))
    counts = Counter(p for *_, links, _ in docs for p in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    return [(len(p[0]), len(p[1]), len(cuts), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest(g)) for p, cuts, links, g in docs]


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_alignment(spark, odd_docs, sf_dir, broadcast, monkeypatch):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", broadcast)
    given = [(r.doc_id, r.text[:3000] if r.text and len(r.text) > 3000 else r.text) for r in odd_docs.collect()]
    given += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect() if len(r.text or "") < 3000]
    given += [(-1, "▁x"), (-2, "a  b  c </s> <0x41> <unk> \x00"), (-3, "a" * 700 + "é" * 300)]
    df = spark.createDataFrame([(*g, "x", 0) for g in given], "doc_id long, text string, end string, key int")
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = sorted(((r.doc_id, *(r[c] for c in columns)) for r in token_alignment.align(df).collect()), key=str)
    wanted = sorted(((i, *x) for (i, _), x in zip(given, plain_alignment([t for _, t in given]), strict=True)), key=str)
    assert found == wanted and (-1, 0, 0, 0, 0, 0, 0, "") in found
    assert token_alignment.align(df.limit(0)).count() == 0


def test_stretches_are_aligned_once(spark):
    """Tokens become rows once for each distinct stretch of a slice, not once a copy."""
    text = "Plain words, again and again.\nOther words " * 20
    rows = lambda n: token_alignment.places(spark.createDataFrame([(i, text) for i in range(n)], "doc_id long, text string").coalesce(1)).filter("code >= 0").count()
    assert 0 < rows(1) == rows(50) < 40


def test_rows_have_many_stretches(spark):
    """A block of stretches is a row and a window's partition, not each stretch."""
    text = "".join(f"{i} x{i}\n" for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").coalesce(1)
    rows = df.mapInArrow(token_alignment._encoder(NAMES), token_alignment._SLICES).count()
    assert rows == 2 + 2 * -(-token_alignment.places(df).agg({"code": "max"}).first()[0] // token_alignment.BLOCK) < 30


def test_stretches_of_the_slice_before(monkeypatch):
    """Stretches that the slice before had aren't encoded again; the sides are the same."""
    import pyarrow as pa

    encoded = []
    of = token_alignment.sides_of
    monkeypatch.setattr(token_alignment, "_last", {})
    monkeypatch.setattr(token_alignment, "sides_of", lambda every, *own: encoded.extend(every) or of(every, *own))
    for given, new in (([" a", " bcd", "\nodd\r"], 3), ([" bcd", " new", "\nodd\r", " a", " xyzzyx"], 2), ([], 0), ([" a"], 1)):
        encoded.clear()
        found = token_alignment.sides_after(pa.array(given, pa.large_string()), NAMES, True)
        assert len(encoded) == new
        for side, wanted in zip(found, of(given, NAMES, True) if given else [([], [])] * 2, strict=True):
            assert [x.tolist() for x in side] == [list(x) for x in wanted]


def test_parts_of_a_slice():
    import pyarrow as pa

    texts = pa.array(["a b a", "", "b c", "a\nb", "d"], pa.large_string())
    parts = [token_alignment.stretches_of(texts.slice(i, 2), True) for i in (0, 2, 4)]
    told, at, counts = token_alignment.one_of(parts)
    whole, where, many = token_alignment.stretches_of(texts, True)
    assert counts.tolist() == many.tolist() and len(set(told.to_pylist())) == len(told)
    assert [told[i].as_py() for i in at.tolist()] == [whole[i].as_py() for i in where.tolist()]


def test_stretches_by_the_library():
    import pyarrow as pa

    pick = random.Random(3)
    signs = [*"abCDé½²ʰ \t\n\x0b\x0c\r\x1c\x85\xa0'…!?.,12#中Σİ\x00▁\u2009\u3000", " ", "\n", "<|endoftext|>", "</s>", "<0x41>", "'ll", "  ", "\n\n\n", "the"]
    texts = ["".join(pick.choices(signs, k=pick.randrange(40))) for _ in range(3000)]
    told, at, counts = token_alignment.stretches_of(pa.array(["x", *texts], pa.large_string()).slice(1), True)
    sides = [np.split(ids, np.cumsum(size)[:-1]) for ids, size in token_alignment.sides_of(told.to_pylist(), NAMES, True)]
    for own, wanted in zip(np.split(at, np.cumsum(counts)[:-1]), token_alignment.tokens_of(texts, NAMES), strict=True):
        found = [[i for x in own for i in side[x].tolist()] for side in sides]
        odd = any(not len(sides[0][x]) for x in own)
        assert ([], []) == wanted if odd else found == list(map(list, wanted))


def test_ids_by_the_library():
    """Token bytes are those that the libraries decode to."""
    for name in NAMES:
        side = token_alignment._side(name)
        text = "Plain words, l'été <|endoftext|> 中文 \n\t 1234"
        ids = side.encode([text])[0]
        assert b"".join(side.bytes[i] for i in ids) == b" " + text.encode()
    assert np.array_equal(token_alignment._side(NAMES[0]).lengths, [len(b) for b in token_alignment._side(NAMES[0]).bytes])
