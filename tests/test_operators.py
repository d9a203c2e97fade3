"""Look-ups, full text, entities and evaluation on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.functions import vectors as V
from quirelake.operators import entities as E
from quirelake.operators import evaluate as EV
from quirelake.operators import expand as X
from quirelake.operators import fulltext as FT
from quirelake.operators import search as S
from quirelake.schema import Graph, GraphError, empty


@pytest.fixture(scope="module")
def graph(spark):
    d = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return Graph(
        papers=d([("p1", "one", None), ("p2", "two", "2020-01-01"), ("p3", "three", "2021-01-01"), ("p4", "four", "2021-01-01")], "arxiv_id string, title string, update_date string").select("*", F.lit("a").alias("abstract"), F.to_timestamp("update_date").alias("first_submitted_at")),
        authors=d([("a", "Ann Bo", "ann bo"), ("b", "Ann Bo", "ann bo"), ("c", "C%d", "cd")], "author_id string, display_name string, normalized_name string"),
        authored=d([("a", "p1", 1), ("b", "p1", 2), ("a", "p2", 1), ("b", "p2", 2), ("c", "p3", 1)], "author_id string, arxiv_id string, position int"),
        in_category=d([("p1", "x", 1, True), ("p2", "x", 1, True), ("p3", "y", 1, True), ("p3", "x", 2, False), ("p4", "x", 1, True)], "arxiv_id string, code string, position int, primary boolean"),
        versions=d([("p1", 1, "v1", None)], "arxiv_id string, version_number int, label string, created_at timestamp"),
        published_in=d([], "arxiv_id string, journal_id string, journal_reference_raw string"),
        journals=d([], "journal_id string, name string"),
        embeddings=d([("p1", "embedding", [1.0, 0.0]), ("p2", "embedding", [0.6, 0.8])], "arxiv_id string, property string, vector array<float>"),
        entities=d([("method", "cnn", "CNN")], "entity_type string, normalized_name string, name string"),
        mentions=d([("p1", "method", "cnn", 0.5)], "arxiv_id string, entity_type string, normalized_name string, confidence double"),
    )


def test_by_author(graph):
    rows = S.papers_by_author(graph, "ánn").collect()
    assert [(r.arxiv_id, r.author_name) for r in rows] == [("p1", "Ann Bo"), ("p2", "Ann Bo")]  # unknown date first
    assert S.papers_by_author(graph, "").count() == 3  # matches every author
    assert S.papers_by_author(graph, "%").count() == 3  # punctuation goes, so it is empty too
    with pytest.raises(GraphError, match="limit"):
        S.papers_by_author(graph, "x", 101)


def test_errors(graph):
    for call, code in ((lambda: S.papers_by_year(graph, 2021, 2020), "INVALID_YEAR_RANGE"), (lambda: S.papers_by_category(graph, "zz", check=True), "CATEGORY_NOT_FOUND"), (lambda: X.expand(graph, []), "EMPTY_PAPER_IDS"), (lambda: E.list_entities(graph, "paper"), "UNKNOWN_ENTITY_TYPE"), (lambda: E.papers_for_entity(graph, "method", "gnn", check=True), "ENTITY_NOT_FOUND"), (lambda: S.text_vector_search(graph, V.hashing_encoder(2), "  "), "EMPTY_QUERY"), (lambda: X.expand_paper(graph, "zz"), "PAPER_NOT_FOUND")):
        with pytest.raises(GraphError) as e:
            call()
        assert e.value.code == code
    with pytest.raises(Exception, match="INVALID_EMBEDDING_DIMENSION"):
        S.vector_search(graph, [1.0]).collect()


def test_expand(graph):
    context, related = X.expand(graph, ["p1", "p1", "nope"])
    assert [(r.arxiv_id, r.authors, r.categories, r.journal) for r in context.collect()] == [("p1", ["Ann Bo"], ["x"], None)]
    assert [(r.arxiv_id, r.shared_authors, r.shared_categories) for r in related.orderBy("rank").collect()] == [("p2", ["Ann Bo"], ["x"]), ("p4", [], ["x"])]  # homonyms count once; p3's x isn't primary
    scores = {r.arxiv_id: r.score for r in X.expand(graph, ["p1"], [1.0, 0.0])[1].collect()}
    assert scores["p2"] == pytest.approx(0.6 + 0.1 + 0.05, abs=1e-6) and scores["p4"] == pytest.approx(0.05)
    hits = S.vector_search(graph, [1.0, 0.0]).collect()
    assert [(r.arxiv_id, round(r.score, 6)) for r in hits] == [("p1", 1.0), ("p2", 0.8)]


def test_entities_keep_papers(graph):
    rows = {r.arxiv_id: [(m.name, m.confidence) for m in r.methods] for r in E.paper_entities(graph).collect()}
    assert rows == {"p1": [("CNN", 0.5)], "p2": [], "p3": [], "p4": []}


def test_merge(spark, graph):
    ddl = "arxiv_id string, entity_type string, normalized_name string, name string, raw_name string, confidence double, extraction_model string, extracted_at timestamp, seq int"
    rows = spark.createDataFrame([("p1", "method", "cnn", "Cnn", "c1", None, "m", None, 1), ("p1", "method", "cnn", "cNN", "c2", 0.2, "m", None, 2), ("p9", "method", "gnn", "GNN", "g", None, "m", None, 3)], ddl)
    base = Graph(**{**empty(spark).tables(), "papers": graph.papers, "entities": graph.entities})
    once, sent = E.merge_resolved(base, rows)
    twice, _ = E.merge_resolved(once, rows)
    for g in (once, twice):
        assert {(r.normalized_name, r.name) for r in g.entities.collect()} == {("cnn", "CNN"), ("gnn", "GNN")}  # the first name stays
        assert [(r.arxiv_id, r.raw_name, r.confidence) for r in g.mentions.collect()] == [("p1", "c2", 0.2)]  # both ends must exist
    assert [(r.entities, r.mentions) for r in sent.collect()] == [(2, 3)]


def test_greedy_clusters():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    founders, wanted = [], []
    for i, x in enumerate(v):
        best = max(founders, key=lambda j: (float(v[j] @ x), -j), default=None)
        if best is not None and float(v[best] @ x) >= 0.6:
            wanted.append(best)
        else:
            founders.append(i)
            wanted.append(i)
    assert E.greedy_clusters(v, 0.6) == E.greedy_clusters(v, 0.6, 7) == E.greedy_clusters(v, 0.6, 1) == wanted
    same = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert E.greedy_clusters(same, 1.0) == [0, 0, 2]  # the threshold is inclusive


def test_needs_extraction(spark):
    one = [("x", "method")]
    done = spark.createDataFrame([("a", one), ("b", []), ("c", []), ("c", one)], "paper_id string, entities array<struct<name: string, type: string>>")
    shards = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("b", "3", 3), ("c", "4", 4), ("d", "5", 5)], "arxiv_id string, title string, seq int")
    assert [(r.arxiv_id, r.title) for r in E.needs_extraction(shards, done).orderBy("arxiv_id").collect()] == [("b", "2"), ("d", "5")]
    assert E.extract_until_done(shards, lambda: done, lambda left: None) == 1  # stops without progress


def test_answers(spark):
    rows = ['{"entities":[{"name":"A","type":"method"},{"name":"","type":"topic"},{"name":"B","type":"x"}]}', "no", "[1]", "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "a string").select(T.parse_entities("a").alias("e"))
    assert [[x.name for x in r.e] for r in df.collect()] == [["A"], [], [], []]
    batch = '{"papers":[{"index":1,"entities":[{"name":"A","type":"method"}]},{"index":9,"entities":[]}]}'
    assert [[x.name for x in p] for p in spark.createDataFrame([(batch,)], "a string").select(T.parse_batch_entities("a", 3).alias("e")).first().e] == [[], ["A"], []]


def test_fulltext(spark, tmp_path):
    docs = spark.createDataFrame([("1", "Graph neural networks", "deep graph models"), ("2", "Neural graph", None), ("3", "Other", "networks of neurons")], "arxiv_id string, title string, abstract string")
    ids = lambda q: {r.arxiv_id for r in FT.search(docs, q).collect()}
    assert ids("graph") == {"1", "2"} and ids('"graph neural"') == {"1"} and ids("neur*") == {"1", "2", "3"}
    assert ids("+graph -deep") == {"2"} and ids("title:networks") == {"1"} and ids("graph AND deep") == {"1"} and ids("graph NOT deep") == {"2"} and ids("deep OR other") == {"1", "3"}
    assert ids("(deep OR other) AND network*") == {"1", "3"} and ids("graph AND (deep OR other)") == {"1"} and ids("graph -(deep OR other)") == {"2"} and ids("+(neural (other AND deep)) +graph") == {"1", "2"}
    assert ids("grahp~") == {"1", "2"} and ids("grpah~1") == set() and ids("neurol~1") == {"1", "2"} and ids("title:networkz~1") == {"1"}
    assert ids("net?orks") == {"1", "3"} and ids("*ons") == {"3"} and ids("n*l") == {"1", "2"} and ids("title:[graph TO n]") == {"1", "2"} and ids("title:{graph TO neural}") == {"1"} and ids("title:[o TO *]") == {"3"}
    assert ids(r"deep\+graph") == {"1"} and ids("graph NOT (deep)") == {"2"} and ids("(graph)^3") == {"1", "2"} and ids("-graph") == set() and ids("title:(other graph)") == {"1", "2", "3"}
    score = lambda q: {r.arxiv_id: r.score for r in FT.search(docs, q).collect()}["1"]
    assert score("graph^3 deep") == pytest.approx(3 * score("graph") + score("deep")) and score("(graph deep)^2") == pytest.approx(2 * score("graph deep")) and score("neur*^2") == 2.0
    for bad in ("", '"open', "(a", "a AND", "NOT", "title:", "*a b*c*x(", "x:y", "a)", "AND a", "a OR OR b", "a~3", '"a b"~2', "[a b]", "a^", "()("):
        with pytest.raises(ValueError):
            FT.search(docs, bad).collect()
    with pytest.raises(GraphError, match="at most 100"):
        FT.search(docs, "graph", limit=101)
    path = str(tmp_path / "index")
    FT.write_index(docs, path)
    index = FT.read_index(spark, path)
    for q in ("graph networks", '"graph neural"', '+"neural graph" -deep', "neur*", "title:neur* networks", "+graph -deep", "graph AND deep", '"deep graph models" OR other', "nothing", "the NOT graph", "(deep OR other) AND network*", "grahp~ title:net?orks^2", "+(neural (other AND deep)^2) graph -[x TO z]", "*ons OR neurol~1"):
        a = {r.arxiv_id: r.score for r in FT.search(docs, q).collect()}
        b = {r.arxiv_id: r.score for r in FT.search_index(*index, q).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a), q
    with pytest.raises(ValueError):
        FT.search_index(*index, "x:y")


def test_fulltext_without_limit(spark, sf_dir):
    from quirelake.plans.catalogue import QUERIES

    docs = spark.range(30).select(F.col("id").cast("string").alias("arxiv_id"), F.lit("a graph").alias("title"), F.lit("of nodes").alias("abstract"))
    assert FT.search(docs, "+graph", limit=None).count() == 30 and FT.search(docs, "+graph").count() == 10
    plan = QUERIES["fulltext_phrase"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_index_segments(spark, tmp_path):
    """Adding and deleting a few documents writes a few, and scores are those of an index
    that is written anew."""
    words = [f"w{i % 17} w{i % 5} graph x{i}" for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "arxiv_id string, title string, abstract string")
    rows = {f"{i:03d}": (f"{i:03d}", w, None if i % 4 else f"about {w}") for i, w in enumerate(words)}
    path = tmp_path / "index"
    FT.write_index(frame(list(rows.values())), str(path))
    size = lambda: {str(p): p.stat().st_size for p in path.rglob("*.parquet")}
    before = size()

    def same():
        FT.write_index(frame(list(rows.values())), str(tmp_path / "new"))
        old, new = FT.read_index(spark, str(path)), FT.read_index(spark, str(tmp_path / "new"))
        assert sorted(map(tuple, old[1].collect())) == sorted(map(tuple, new[1].collect()))
        for q in ("graph w3", '"graph x7"', "fresh", "x29* -w4"):
            a, b = ({r.arxiv_id: r.score for r in FT.search_index(*x, q, limit=None).collect()} for x in (old, new))
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a), q

    changed = [("007", "fresh graph", "new words"), ("300", "w3 graph fresh", None), ("301", None, None)]
    FT.add_docs(frame(changed), str(path))
    rows |= {r[0]: r for r in changed}
    same()
    gone = ["005", "300", "nobody"]
    FT.delete_docs(spark.createDataFrame([(x,) for x in gone], "arxiv_id string"), str(path))
    for x in gone:
        rows.pop(x, None)
    same()
    after = size()
    assert before.items() <= after.items() and sum(v for k, v in after.items() if k not in before and "/postings/" in k) < 0.3 * sum(v for k, v in before.items() if "/postings/" in k)
    FT.delete_docs(spark.createDataFrame([("nobody",)], "arxiv_id string"), str(path))
    FT.add_docs(frame([("300", "back w3", None)]), str(path), most=2)  # three segments become one
    rows["300"] = ("300", "back w3", None)
    assert len(FT._state(spark, str(path))["segments"]) == 1
    same()
    FT.vacuum_index(spark, str(path))
    assert len(list((path / "postings").iterdir())) == 1 and not list((path / "deletions").iterdir())
    same()
    with pytest.raises(GraphError, match="none"):
        FT.read_index(spark, str(tmp_path / "none"))


def test_metrics(spark):
    cases = spark.createDataFrame([("s", ["a", "b"], "a"), ("s", ["a", "b"], "x")], "source string, ranked_ids array<string>, expected_paper_id string")
    total = {r.source: r for r in EV.summarize(EV.ranks_of(cases), (1, 2)).collect()}
    assert (total[None]["count"], total[None].mrr, total[None].recall_at_1, total[None].recall_at_2) == (2, 0.5, 0.5, 0.5)
    none = EV.summarize(EV.ranks_of(cases.limit(0)), (1, 5)).filter("source IS NULL").first()
    assert (none["count"], none.mrr, none.recall_at_5) == (0, 0.0, 0.0)
    rates = {r.entity_type: (r.precision, r.recall, r.f1) for r in EV.precision_recall(spark.createDataFrame([("m", 1, 1, 0), ("t", 0, 0, 0)], "entity_type string, tp int, fp int, fn int")).collect()}
    assert rates["t"] == (0.0, 0.0, 0.0) and rates[None][0] == 0.5 and rates["m"][1] == 1.0
    score = EV.resolution_score(spark.createDataFrame([], "entity_type string, name string, normalized_name string"), EV.synonym_pairs(spark)).first()
    assert (score.merge_recall, score.merge_precision, score.evaluated) == (0.0, 1.0, 0)
    assert V.percentile([3, 1, 2, 4], 0.5) == 3 and V.percentile([1], 0.95) == 1
    rated = spark.createDataFrame([("s", "q", 1, 1.0), ("s", "q", 2, 0.0)], "source string, query_id string, rank int, relevance double")
    assert EV.gain(rated, 2).first().ndcg_at_2 == 1.0


def test_prompts(spark):
    row = spark.createDataFrame([("T", "A deep network for graph data. A Deep network", ["x", "y"])], "t string, a string, c array<string>")
    assert row.select(T.user_prompt("t", "a", "c").alias("p")).first().p.endswith("these): x, y")
    assert row.select(T.candidate_phrases("a").alias("p")).first().p == ["deep network", "graph data"]
    assert row.select(T.batch_prompt(F.array(F.struct(F.col("t").alias("title"), F.col("a").alias("abstract"), F.col("c").alias("candidates")))).alias("p")).first().p.startswith("=== Paper 0 ===\nTitle: T\n\nAbstract: A deep")


def test_percentiles_without_groups(spark):
    values = [float(x) for x in np.random.default_rng(3).integers(0, 50, 999)]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)] + [(None, "a")], "v double, g string").repartition(8)
    row = EV.percentiles(df, "v", shares=(0.0, 0.5, 0.95, 1.0)).first()
    assert (row.n, row.p0, row.p50, row.p95, row.p100) == (999, min(values), V.percentile(values, 0.5), V.percentile(values, 0.95), max(values))
    for r in EV.percentiles(df, "v", "g").collect():
        own = values["ab".index(r.g) :: 2]
        assert (r.n, r.p50, r.p95) == (len(own), V.percentile(own, 0.5), V.percentile(own, 0.95))


def test_nearest_is_by_cosine(spark):
    v = spark.createDataFrame([(1, [10.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0])], "key long, vector array<double>")
    q = spark.createDataFrame([(7, [3.0, 4.0])], "query_id long, vector array<double>")
    assert [(r.key, round(r.score, 6)) for r in EV.nearest(q, v).orderBy("rank").collect()] == [(2, 1.0), (1, 0.6), (3, 0.0)]


@pytest.mark.parametrize("block", [64 << 20, 8 * 6 * 7])
def test_nearest_by_brute_force(spark, block):
    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(300, 6)).round(1), rng.normal(size=(20, 6)).round(1)
    m[10:15] = m[9]  # ties
    m[20] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "key long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*q, m[9]])], "query_id long, vector array<double>")
    found = EV.nearest(queries, vectors, 7, block)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    close = (unit(np.concatenate([q, m[9:10]])) @ unit(m).T).round(12)
    wanted = {(i, int(k), r + 1) for i in range(21) for r, k in enumerate(np.lexsort((np.arange(300), -close[i]))[:7])}
    assert {(r.query_id, r.key, r["rank"]) for r in found.collect()} == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange" in x]
    assert exchanges and "CoGroup" not in plan and plan.index("MapInPandas") > plan.index("Exchange")  # vectors are read below all exchanges
    assert EV.nearest(queries.limit(0), vectors).count() == 0 and EV.nearest(queries, vectors.limit(0)).count() == 0


def test_acronyms_join_their_expansions(spark):
    pairs = [(a, b, kind, merge) for a, b, kind, merge in EV.SYNONYM_PAIRS]
    names = sorted({(kind, x) for a, b, kind, _ in pairs for x in (a, b)})
    rows = [(i, "p", name, kind, "m", "t") for i, (kind, name) in enumerate(names)]
    mentions = spark.createDataFrame([*rows, (900, "p", "CNNs", "method", "m", "t")], "seq long, paper_id string, name string, entity_type string, extraction_model string, extracted_at string")
    encode = V.encode_udf(V.hashing_encoder)
    found = E.resolve(mentions, encode, 0.95, acronyms=True)
    to = {(r.entity_type, r.raw_name): r.name for r in found.collect()}
    for a, b, kind, merge in pairs:
        assert (to[kind, a] == to[kind, b]) == merge, (a, b)
    assert to["method", "CNNs"] == "convolutional neural network"
    score = EV.resolution_score(found.select("entity_type", F.col("raw_name").alias("name"), "normalized_name"), EV.synonym_pairs(spark)).first()
    assert score.merge_recall == 1.0 and score.merge_precision == 1.0
    assert E.resolve(mentions, encode, 0.95).filter("raw_name = 'CNN' AND name <> 'CNN'").count() == 0


def test_dot_of_unequal_lengths(spark):
    row = spark.createDataFrame([([1.0, 2.0, 5.0], [3.0, 4.0], None)], "a array<double>, b array<double>, c array<double>")
    assert tuple(row.select(V.dot("a", "b"), V.dot("b", "a"), V.dot("a", "c")).first()) == (11.0, 11.0, None)


def test_eval_files(spark, tmp_path):
    rows = [("a query", "1234.5678", "paraphrased"), ("another query", "8765.4321", "self_retrieval")]
    EV.write_eval(spark.createDataFrame(rows, "query string, expected_paper_id string, source string"), str(tmp_path / "a"))
    (tmp_path / "b.jsonl").write_text('{"query": "q1", "expected_paper_id": "1", "source": "s"}\n\n{"query": "q2", "expected_paper_id": "2", "source": "s"}\n')
    with pytest.warns(UserWarning, match="left out"):
        found = EV.read_eval(spark, str(tmp_path / "a"), str(tmp_path / "none.jsonl"), str(tmp_path / "b.jsonl"))
    assert sorted(tuple(r) for r in found.collect()) == sorted([*rows, ("q1", "1", "s"), ("q2", "2", "s")])


def test_caps(graph):
    with pytest.raises(GraphError, match="at most 200"):
        E.papers_for_entity(graph, "method", "cnn", 201)
    assert [r.arxiv_id for r in EV.sample_embedded(graph, 1).collect()] == ["p1"]


def test_extraction_failures(spark):
    from quirelake.operators import extraction as EX

    papers = spark.createDataFrame([(f"p{i}", "t", f"deep networks {i} for graph data") for i in range(5)], "arxiv_id string, title string, abstract string")

    def client(prompt, tokens):
        if "networks 3" in prompt:
            raise OSError
        assert tokens in (512, 1024)
        return EX.phrases_client(prompt, tokens)

    for per, lost in ((1, {"p3"}), (2, {"p2", "p3"})):
        rows = EX.extract(papers, client, "m", per).collect()
        assert [r.paper_id for r in rows] == [f"p{i}" for i in range(5)]
        assert {r.paper_id for r in rows if not r.entities} == lost


def test_index_is_shuffled_in_packs(spark, tmp_path):
    words = [f"w{i % 97}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 7 :]), "Title w3" if i % 2 else None) for i in range(300)] + [(300, None, ""), (None, "w5 w5", None)], "doc_id long, text string, title string")
    found = FT.postings(docs, "doc_id", ["text", "title"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # the grouping by document was one
    wanted = []
    for d in docs.collect():
        for f in ("text", "title"):
            own = (d[f] or "").lower().split()
            wanted += [(d.doc_id, f, len(own), w, own.count(w), [i for i, x in enumerate(own) if x == w]) for w in set(own)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    FT.write_index(docs, str(tmp_path / "index"), "doc_id", ["text", "title"])
    assert sorted(map(tuple, FT.read_index(spark, str(tmp_path / "index"))[0].collect()), key=str) == sorted(wanted, key=str)


@pytest.mark.parametrize(("first", "block"), [(8192, 64 << 20), (30, 8 * 6 * 7), (1, 64 << 20)])
def test_retrieval_counts_what_comes_before(spark, first, block):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 6))
    m[40:80] = m[5]  # copies: ties go to the smaller key
    m[81] = 0
    expected = rng.integers(0, 300, 300)
    expected[:8], expected[40:60] = 5, 50
    expected[7] = 999  # isn't there
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "key long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist(), int(expected[i]), f"s{i % 3}") for i, x in enumerate(m)], "query_id long, vector array<double>, expected long, source string")
    found = {r.source: r for r in EV.retrieval(queries, vectors, 10, block_bytes=block, first=first).collect()}
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    order = [np.lexsort((np.arange(300), -x)).tolist() for x in (unit @ unit.T).round(12)]
    rank = np.array([order[i].index(e) + 1 if e < 300 else 999 for i, e in enumerate(expected)])
    assert (rank <= 10).sum() > 5
    for s, own in [(None, rank), *((f"s{k}", rank[k::3]) for k in range(3))]:
        assert found[s]["count"] == len(own)
        assert [found[s][c] for c in ("mrr", "recall_at_1", "recall_at_5", "recall_at_10")] == pytest.approx([np.where(own <= 10, 1 / own, 0).mean(), *((own <= k).mean() for k in (1, 5, 10))])
    none = EV.retrieval(queries.limit(0), vectors).collect()
    assert [(r.source, r["count"], r.mrr) for r in none] == [(None, 0, 0.0)]
    assert {r.mrr for r in EV.retrieval(queries, vectors.limit(0)).collect()} == {0.0}
