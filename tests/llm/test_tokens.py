"""Token counts, chunked encoding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import bpe_chunks, packing, token_counts
from quirelake.llm.common import hf_tokenizer

ODD = st.lists(st.sampled_from([*"abCDé½²ʰ \t\n\x0b\x0c\r\x1c\x85\xa0'…!?.,12#中̧́ΣςİK", "<|endoftext|>", "<|startoftext|>", "'ll", "  ", ", ", ".\n"]), max_size=80).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_chunks_round_trip(text):
    made = hf_tokenizer(bpe_chunks.TOKENIZER)
    own = bpe_chunks.encoder(bpe_chunks.TOKENIZER, 4)
    for t in (text, text + " " + text[::-1] + " plain words between"):
        ids = made.encode(t, add_special_tokens=False).ids
        found = own.encode_all([t.encode()])
        assert found[0].tolist() == ids
        assert own.decode_all(found) == [made.decode(ids, skip_special_tokens=False)]


def test_joins_are_widened_until_they_agree(monkeypatch):
    text = " ".join(random.Random(5).choices([f"word{i}," for i in range(300)], k=2000))
    own = bpe_chunks.ChunkEncoder(bpe_chunks.TOKENIZER, 9)
    wanted = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.encode_all([text.encode()])[0].tolist() == wanted and own.joins > 15 and own.widened == 0
    agrees = own.agrees
    own.agrees = lambda left, right, words, ids: words > bpe_chunks.WINDOW and agrees(left, right, words, ids)
    assert own.encode_all([text.encode()])[0].tolist() == wanted and own.widened > 15


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_another_tokenizer(text):
    own = bpe_chunks.encoder(packing.TOKENIZER, 5)
    text = text + " one two, three \n" * 20 + text
    ids = own.encode_all([text.encode()])
    assert not own.wordwise and ids[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.decode_all(ids) == [text]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_stretches(text):
    import pyarrow as pa

    own = packing._encoders.setdefault(packing.TOKENIZER, packing.Encoder(packing.TOKENIZER) if packing.TOKENIZER not in packing._encoders else None)
    texts = [text, "", "plain words, and " + text.strip(), text.replace("  ", " ").strip(" \n") or "a"]
    ids, bounds = own.encode_all(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        assert ids[a:b].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_chunks_are_reused():
    passage = " ".join(random.Random(1).choices([f"word{i}" for i in range(500)], k=3000)).encode()
    own = bpe_chunks.ChunkEncoder(bpe_chunks.TOKENIZER)
    own.encode_all([passage, b"something else in front, " + passage])
    assert own.reused > 0.8 * own.made


def test_counts_and_digests(spark, odd_docs):
    made = hf_tokenizer(token_counts.TOKENIZER)
    texts = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=str)
    wanted = [(d, len(t.encode()), len(made.encode(t, add_special_tokens=False).ids)) for d, t in texts]
    rows = token_counts.token_counts(odd_docs, entries=3).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=str) == sorted(wanted, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    digests = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.digests(odd_docs).collect()}
    for d, t in texts:
        if d is not None:
            ids = made.encode(t, add_special_tokens=False).ids
            assert digests[d] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(made.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    encoded = {r.doc_id: r.ids for r in bpe_chunks.encode(odd_docs).collect()}
    assert encoded[10] == made.encode(dict(t for t in texts if t[0])[10], add_special_tokens=False).ids
    none = odd_docs.limit(0)
    assert token_counts.token_counts(none).count() == bpe_chunks.digests(none).count() == packing.pack(none).count() == 0


@pytest.mark.parametrize("length", [16, 2048])
def test_packing(spark, sf_dir, odd_docs, length):
    made = hf_tokenizer(packing.TOKENIZER)
    docs = odd_docs.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    if length == 2048:
        docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    want = {r.doc_id: made.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    frame = packing.pack(docs, length=length, with_ids=True).toPandas()
    for d, g in frame.sort_values("start").groupby("doc_id"):
        at = 0
        for x in g.itertuples():
            own = want[d][at : at + x.length]
            assert (x.start, x.doc_tokens, list(x.ids)) == (at, len(want[d]), own)
            assert x.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            at += x.length
        assert at == len(want[d])
    assert set(frame.doc_id) == set(want)
    sizes = []
    for _, g in frame.sort_values("offset").groupby("sequence_id"):
        at = 0
        for x in g.itertuples():
            assert x.offset == at
            at += x.length
        assert at <= length
        sizes.append(at)
    assert sum(s < length for s in sizes) <= 4  # the last of each of four partitions


def test_neighbours_are_lexical():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * k, 100 * k + 90, 60) for k in range(4) for _ in range(5)]
    order = rng.permutation(20)
    docs = [topics[i] for i in order]
    index = packing.Index(docs, np.ones(500), 60)
    for seed in range(20):
        best = np.argsort(-index.scores(seed), kind="stable")[:5]
        assert {order[b] // 5 for b in best} == {order[seed] // 5}


def plain_packing(docs, idf, mean, length):
    """The pieces of one shard: BM25 written out, neighbours queued as documented."""
    weights = []
    for d in docs:
        terms, n = np.unique(d, return_counts=True)
        weights.append({int(t): k * (packing.K1 + 1) / (k + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) * idf[t] for t, k in zip(terms, n, strict=True)})
    score = lambda seed, d: sum(weights[d].get(t, 0.0) for t in weights[seed])
    sizes, unused = [len(d) + 1 for d in docs], set(range(len(docs)))
    rows, queue, seed, sequence, filled = [], [], -1, 0, 0
    while unused:
        queue = [d for d in queue if d in unused]
        if queue:
            doc = queue.pop(0)
        else:
            doc = seed = min(unused)
        unused.discard(doc)
        start = 0
        while start < sizes[doc]:
            if not filled:
                seed, queue = doc, []
            n = min(sizes[doc] - start, length - filled)
            rows.append((doc, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == length:
                sequence, filled = sequence + 1, 0
        if filled and not [d for d in queue if d in unused]:
            near = sorted(((-round(score(seed, d), 9), d) for d in unused if score(seed, d) > 0))
            queue = [d for _, d in near[: packing.NEIGHBOURS]]
    return rows


@pytest.mark.parametrize("length", [40, 100])
def test_greedy_filling_by_a_plain_packer(length):
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 60, rng.integers(1, 50)) + 60 * int(rng.integers(0, 4)) for _ in range(120)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=256)
    idf, mean = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    found = packing.Packer(length).pack([len(d) + 1 for d in docs], packing.Index(docs, idf, mean))
    assert found == plain_packing(docs, idf, mean, length)


def test_keys_by_definition():
    rng = np.random.default_rng(8)
    docs = [rng.integers(0, 9, n).astype(np.uint16) for n in (0, 1, 3, 4, 5, 30, 0, 4)]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    alone = [int(packing.keys_of(d, np.array([0, len(d)]))[0]) for d in docs]
    assert packing.keys_of(np.concatenate(docs), bounds).tolist() == alone
    whole = docs[5]
    fours = [packing.keys_of(whole[i : i + 4], np.array([0, 4]))[0] for i in range(len(whole) - 3)]
    assert alone[5] == min(fours) and alone[:3] == [0, int(docs[1][0]), int(docs[2][0])]


def test_all_documents_by_the_library(spark, sf_dir):
    made = hf_tokenizer(token_counts.TOKENIZER)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id: made.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.query(spark, sf_dir).collect()} == {d: len(x) for d, x in ids.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.query(spark, sf_dir).collect()}
    assert found == {d: (sha(" ".join(map(str, x))), sha(made.decode(x, skip_special_tokens=False))) for d, x in ids.items()}


def test_long_pre_tokens_count_whole(spark):
    word = "x" * 5000 + "é" * 3000
    text = f"{word} {word}, {'7' * 2000} <|endoftext|>{word}"
    made = hf_tokenizer(token_counts.TOKENIZER)
    docs = spark.createDataFrame([(1, text), (2, "y" * 64 + " " + "z" * 64)] * 3, "doc_id long, text string")
    assert {r.n_tokens for r in token_counts.token_counts(docs).filter("doc_id = 1").collect()} == {len(made.encode(text, add_special_tokens=False).ids)}


def test_repeated_rows_are_packed(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")
    assert packing.pack(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].loc[1] == 2


def test_table_is_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 50)  # counts are handed on in parts
    rare = [(i, f"filler{i} other{i % 900} only{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame([*rare, (6000, "needle " * 9000)], "doc_id long, text string").repartition(6)
    wanted: dict[str, int] = {}
    own = token_counts.PreTokens(token_counts.TOKENIZER)
    for _, text in [*rare, (6000, "needle " * 9000)]:
        for word in text.split():
            for piece in own.of(word):
                wanted[piece] = wanted.get(piece, 0) + 1
    assert token_counts.frequent(docs, entries=20) == sorted(wanted, key=lambda w: (-wanted[w], w))[:20]


def test_words_met_again_are_kept():
    import pyarrow as pa

    from quirelake.llm.words import WordIds

    own = WordIds(bpe_chunks.TOKENIZER, 100)
    made = hf_tokenizer(bpe_chunks.TOKENIZER)
    for i in range(6):
        text = "often and " + " ".join(f"once{i}x{j}" for j in range(60)) + " again"
        ids, _, counts = own.encode(pa.array([text], pa.large_string()))
        assert ids.tolist() == made.encode(text, add_special_tokens=False).ids and counts.tolist() == [63]
        assert i < 3 or len(own.place) <= 163
    own.keep()
    assert {"often", "and", "again"} <= set(own.place) and len(own.place) < 70
