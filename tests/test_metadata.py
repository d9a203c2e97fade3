"""Metadata from JSON lines to tables."""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import search, stats
from quirelake.schema import GraphError, empty
from quirelake.sources import metadata as M
from quirelake.sources import tables
from quirelake.streaming import ingest as I

# A record and what it becomes.
RECORD = {
    "id": "0704.0047",
    "submitter": "Igor Grabec",
    "title": " Title ",
    "comments": "5 pages, 5 eps figures, uses IEEEtran.cls",
    "journal-ref": None,
    "doi": " ",
    "categories": "cs.NE cs.AI cs.NE",
    "abstract": "\n  About\nit.\n",
    "versions": [{"version": "v1", "created": "Sun, 1 Apr 2007 13:06:50 GMT"}],
    "update_date": "2009-09-29",
    "authors_parsed": [["Kosel", "T.", ""], [], ["Grabec", "I.", "Jr"], ["Kosel", "T.", ""]],
}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def load(spark, path):
    return M.transform(M.read_metadata(spark, path))


@pytest.mark.parametrize("value, wanted", [("Igor Grabec", "igor grabec"), ("É. Grabec", "e grabec"), ("T. Kosel", "t kosel"), ("Jean-Paul Sartre", "jean-paul sartre"), ("  Igor   Grabec  ", "igor grabec")])
def test_normalize_name(value, wanted):
    assert T.normalize_name(value) == wanted


def test_transform(spark, tmp_path):
    row = load(spark, lines(tmp_path / "a.jsonl", RECORD)).first()
    assert (row.arxiv_id, row.title, row.abstract, row.doi, row.source) == ("0704.0047", "Title", "About\nit.", None, "arXiv")
    assert row.update_date == dt.date(2009, 9, 29)
    assert [(a.position, a.display_name) for a in row.authors] == [(1, "T. Kosel"), (3, "I. Grabec Jr"), (4, "T. Kosel")]
    assert [(c.code, c.position, c.primary) for c in row.categories] == [("cs.NE", 1, True), ("cs.AI", 2, False), ("cs.NE", 3, False)]
    v = row.versions[0]
    assert (v.label, v.version_number) == ("v1", 1)
    assert v.created_at.replace(tzinfo=dt.timezone.utc).timestamp() == 1175432810 or v.created_at.timestamp() == 1175432810


def test_graph_last_wins(spark, tmp_path):
    again = {**RECORD, "title": "New", "abstract": None, "authors_parsed": [["Solo", "A.", None]]}
    old = M.graph_of(load(spark, lines(tmp_path / "a.jsonl", RECORD)))
    both = M.graph_of(load(spark, lines(tmp_path / "b.jsonl", RECORD, "", again)))
    assert [(r.title, r.abstract, r.version_count, r.latest_version) for r in both.papers.collect()] == [("New", None, 1, "v1")]
    # the same author twice in one paper has its last place, and old edges stay
    assert {(r.display_name, r.position) for r in old.authored.join(old.authors, "author_id").collect()} == {("T. Kosel", 4), ("I. Grabec Jr", 3)}
    merged = M.merge_graph(M.merge_graph(empty(spark), old), both)
    assert merged.authored.count() == 3 and both.authored.count() == 3
    fresh = M.merge_graph(old, M.graph_of(load(spark, lines(tmp_path / "c.jsonl", again))), replace_edges=True)
    assert fresh.authored.count() == 1
    codes = {r.code: (r.position, r.primary) for r in old.in_category.collect()}
    assert codes == {"cs.NE": (3, False), "cs.AI": (2, False)}


def test_optional_fields(spark, tmp_path):
    row = load(spark, lines(tmp_path / "a.jsonl", '{"id":"0704.0001","journal-ref":"Phys.Rev.D76:013009,2007","doi":"10.1103/PhysRevD.76.013009","report-no":"ANL-HEP-PR-07-12"}', '{"id": 704.0001}')).orderBy("arxiv_id").collect()
    assert (row[0].doi, row[0].journal_reference_raw, row[0].report_number) == ("10.1103/PhysRevD.76.013009", "Phys.Rev.D76:013009,2007", "ANL-HEP-PR-07-12")
    assert row[1].arxiv_id == "704.0001" and row[1].authors == [] and row[1].versions == []


def test_bad_lines(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", RECORD, "not json", "[1]", "", RECORD)
    with pytest.raises(Exception, match="a.jsonl line 2: not a JSON object: not json"):
        M.read_metadata(spark, path).collect()
    assert M.read_metadata(spark, path, strict=False).count() == 2
    assert M.with_category(M.read_metadata(spark, path, strict=False)).count() == 2
    assert M.first_with_category(M.read_metadata(spark, path, strict=False), "cs.A").count() == 0


@pytest.mark.parametrize("value, wanted", [("Sun, 1 Apr 2007 13:06:50 GMT", 1175432810), ("Sun, 01 Apr 2007 13:06:50 +0200", 1175425610), ("2007-04-01T13:06:50Z", 1175432810), ("2007-04-01T13:06:50+00:00", 1175432810), ("garbage", None), ("  ", None)])
def test_dates(spark, value, wanted):
    assert spark.range(1).select(F.unix_timestamp(T.created_at(F.lit(value))).alias("t")).first().t == wanted


def test_samples(spark):
    df = spark.range(200).select(F.concat(F.lit('{"id":"'), "id", F.lit('"}')).alias("line"))
    one = [sorted(r.line for r in M.sample_lines(df, 20, seed).collect()) for seed in (42, 42, 1, 2)]
    assert one[0] == one[1] and len(one[0]) == 20 and one[2] != one[3]
    odd = spark.createDataFrame([('{"a":1}',), ("not valid json",), ('{"b":2}',)], "line string")
    assert M.sample_lines(M.valid_lines(odd), 10, 1).count() == 2


def test_incremental(spark, tmp_path):
    source, target, mark = (tmp_path / x for x in ("in", "out", "mark"))
    source.mkdir()
    lines(source / "1.jsonl", *({"id": f"1000.000{i}", "title": "t", "abstract": "a"} for i in range(1, 6)))
    run = lambda: I.ingest(spark, str(source), str(target), str(mark))
    assert run() == 5 and run() == 0
    lines(source / "2.jsonl", {"id": "1000.0005", "title": "new"}, {"id": "1000.0006"})
    assert run() == 2
    papers = {r.arxiv_id: r.title for r in I.current(spark, str(target)).papers.collect()}
    assert len(papers) == 6 and papers["1000.0005"] == "new"


def test_retry():
    calls = []

    def fail():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    waits: list[float] = []
    assert I.with_retry(fail, sleep=waits.append) == "done"
    assert len(waits) == 2 and 1 <= waits[0] <= 1.25 and 2 <= waits[1] <= 2.5
    with pytest.raises(OSError):
        I.with_retry(lambda: (_ for _ in ()).throw(OSError()), retries=1, sleep=waits.append)


def test_detail_needs_all_lists(spark, tmp_path):
    g = M.graph_of(load(spark, lines(tmp_path / "a.jsonl", RECORD, {"id": "2", "title": "t", "abstract": "a", "categories": "x"})))
    assert [r.arxiv_id for r in search.paper_detail(g).collect()] == ["0704.0047"]
    bad = {r.name: r.violations for r in stats.validate(g).collect()}
    assert bad["papers_without_authors"] == 1 and bad["papers_without_categories"] == 0
    assert stats.report([{"name": "a", "violations": 0, "passed": True, "description": "d"}, {"name": "b", "violations": 3, "passed": False, "description": "why"}]) == (["PASS a: 0", "FAIL b: 3", "     why"], False)
    with pytest.raises(ValueError):
        stats.parse_checks("SELECT 1")


def test_line_numbers(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", "", RECORD, "  ", *([RECORD] * 300), "")
    wanted = [2, *range(4, 304)]
    try:
        for size in ("128m", "4k"):  # one split, and many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert [r.line_no for r in M.read_metadata(spark, path).orderBy("seq").collect()] == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert M.peek(spark, path).first().line == ""
    M.write_lines(spark.createDataFrame([("x",), ("y",)], "line string"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_load_batches(spark, tmp_path):
    # Ids, batches of two
    path, mark = lines(tmp_path / "a.jsonl", *({"id": f"1000.000{i}"} for i in range(1, 6))), str(tmp_path / "mark")
    seen = []
    put = lambda df: seen.append([r.record.id for r in df.orderBy("line_no").collect()])
    assert M.load_batches(spark, path, put, mark, 2) == 5
    assert seen == [["1000.0001", "1000.0002"], ["1000.0003", "1000.0004"], ["1000.0005"]]
    assert M.load_batches(spark, path, put, mark, 2) == 0
    calls = []

    def fail(df):
        calls.append(df.count())
        if len(calls) == 2:
            raise OSError("no room")

    with pytest.raises(GraphError, match="lines 3 to 4: no room"):
        M.load_batches(spark, path, fail, mark, 2, resume=False)
    row = M.read_control(spark, mark, path)
    assert (row["last_line"], row["last_id"]) == (2, "1000.0002") and row["size"] == os.path.getsize(path) and row["path"].endswith("/a.jsonl")
    seen.clear()
    assert M.load_batches(spark, path, put, mark, 50) == 3 and seen == [["1000.0003", "1000.0004", "1000.0005"]]


def test_changed_sources_load_whole(spark, tmp_path):
    path, mark = tmp_path / "a.jsonl", str(tmp_path / "mark")
    seen = []
    put = lambda df: seen.extend(r.record.id for r in df.orderBy("line_no").collect())
    run = lambda: (seen.clear(), M.load_batches(spark, str(path), put, mark, 3), list(seen))[1:]
    lines(path, *({"id": f"a{i}"} for i in range(5)))
    assert run() == (5, [f"a{i}" for i in range(5)])
    lines(path, *({"id": f"b{i}"} for i in range(7)))  # replaced by another, longer file
    assert run() == (7, [f"b{i}" for i in range(7)])
    lines(path, *({"id": f"b{i}"} for i in range(7)), "", {"id": "b7"}, {"id": "b8"})  # grown
    assert run() == (2, ["b7", "b8"]) and run() == (0, [])
    lines(path, *({"id": f"b{i}"} for i in range(6)), {"id": "x6"}, "", {"id": "b7"}, {"id": "b8"})  # edited, of the same size
    assert run()[0] == 9
    lines(path, {"id": "b0"})  # cut
    assert run() == (1, ["b0"])
    (row,) = [x for x in os.listdir(mark) if x.endswith(".json")]
    for bad in ("", "{", "[1]", '{"last_line": "x"}'):
        (tmp_path / "mark" / row).write_text(bad)
        if bad != "{":  # else its checksum is wrong too
            (tmp_path / "mark" / f".{row}.crc").unlink(missing_ok=True)
        assert run() == (1, ["b0"]), bad
    assert run() == (0, [])


def test_changed_files_of_a_stream_are_read_anew(spark, tmp_path):
    source, target, mark = (tmp_path / x for x in ("in", "out", "mark"))
    source.mkdir()
    lines(source / "1.jsonl", {"id": "a", "title": "old"}, {"id": "b", "title": "old"})
    run = lambda: I.ingest(spark, str(source), str(target), str(mark))
    assert run() == 2 and run() == 0
    lines(source / "1.jsonl", {"id": "a", "title": "new one"}, {"id": "c", "title": "new"}, {"id": "d", "title": "new"})
    lines(source / "2.jsonl", {"id": "e", "title": "new"})
    assert run() == 4 and run() == 0
    assert {r.arxiv_id: r.title for r in I.current(spark, str(target)).papers.collect()} == {"a": "new one", "b": "old", "c": "new", "d": "new", "e": "new"}


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_a_small_batch_rewrites_its_buckets_alone(spark, tmp_path):
    rows = [{**RECORD, "id": f"1000.{i:04d}", "title": f"t{i}"} for i in range(200)]
    graph = str(tmp_path / "graph")
    new = lambda *r: M.graph_of(load(spark, lines(tmp_path / f"{uuid.uuid4().hex}.jsonl", *r)))
    assert tables.put(spark, graph, new(*rows), buckets=16) == 0
    before = _files(tmp_path / "graph")
    plain = M.merge_graph(new(*rows), new({**RECORD, "id": "1000.0007", "title": "changed", "categories": "x.YZ"}))
    wanted = {n: sorted(map(str, t.collect())) for n, t in plain.tables().items()}
    assert tables.put(spark, graph, new({**RECORD, "id": "1000.0007", "title": "changed", "categories": "x.YZ"})) == 1
    after = _files(tmp_path / "graph")
    assert before.items() <= after.items()
    added = sorted(set(after) - set(before))
    assert len([p for p in added if "/papers/" in p]) == 1 and all("/g=1/" in p for p in added)
    have = tables.read(spark, graph)
    assert {n: sorted(map(str, getattr(have, n).collect())) for n in wanted} == wanted
    assert tables.read(spark, graph, 0).papers.filter("title = 'changed'").count() == 0
    gone = tables.vacuum(spark, graph)
    assert gone > 0 and tables.versions(spark, graph) == [1] and tables.vacuum(spark, graph) == 0
    have = tables.read(spark, graph)
    assert {n: sorted(map(str, getattr(have, n).collect())) for n in wanted} == wanted
    assert tables.rebucket(spark, graph, 3) == 2 and set(tables.manifest(spark, graph)["tables"]["papers"]) == {"0", "1", "2"}
    have = tables.read(spark, graph)
    assert {n: sorted(map(str, getattr(have, n).collect())) for n in wanted} == wanted
    tables.put(spark, graph, new({**RECORD, "id": "1000.0007", "title": "t", "categories": "only"}), replace_edges=True)
    assert [r.code for r in tables.read(spark, graph).in_category.filter("arxiv_id = '1000.0007'").collect()] == ["only"]
    assert tables.read(spark, graph).in_category.filter("arxiv_id = '1000.0008'").count() > 1


def test_a_batch_that_ends_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    graph = str(tmp_path / "graph")
    new = lambda title: M.graph_of(load(spark, lines(tmp_path / "b.jsonl", {**RECORD, "title": title})))
    tables.put(spark, graph, new("one"), buckets=4)
    with monkeypatch.context() as m:
        m.setattr(tables.files, "write_json", lambda *a, **k: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            tables.put(spark, graph, new("two"))
    assert [r.title for r in tables.read(spark, graph).papers.collect()] == ["one"] and tables.vacuum(spark, graph) == 0
    assert tables.put(spark, graph, new("three")) == 1
    assert [r.title for r in tables.read(spark, graph).papers.collect()] == ["three"]
    with monkeypatch.context() as m:  # another writer was faster
        m.setattr(tables, "manifest", lambda *a: {"version": 0, "buckets": 4, "tables": {}, "applied": {}})
        with pytest.raises(GraphError, match="CONFLICT|already"):
            tables.put(spark, graph, new("four"))


def test_transient_errors_are_tried_again():
    calls, waits = [], []

    def fail(error):
        calls.append(1)
        raise error

    for error, n in ((OSError("x"), 3), (ValueError("java.io.IOException: lost"), 3), (ValueError("not a JSON object"), 1)):
        calls.clear()
        with pytest.raises(type(error)):
            I.with_retry(lambda e=error: fail(e), retries=2, sleep=waits.append, when=I.is_transient)
        assert len(calls) == n


def test_failed_batch_names_its_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines(source / "1.jsonl", {"id": "a"}, {"id": "b"}, "not json")
    with pytest.raises(Exception, match="1.jsonl lines 1 to 3 that aren't blank, number 3 isn't a JSON object"):
        I.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"))


def test_shards_are_whole_under_adaptive_execution(spark):
    papers = spark.range(200_000).select(F.format_string("%07d", F.col("id")).alias("arxiv_id"), F.repeat(F.lit("x"), 50).alias("title"))
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = M.shard_numbers(papers).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("arxiv_id").alias("first")).orderBy("shard").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.shard, r.n, r.first) for r in found] == [(i, 1000, f"{i * 1000:07d}") for i in range(200)]
