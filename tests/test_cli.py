"""The command line, from records to answers."""

from __future__ import annotations

import json

from quirelake.__main__ import main


def test_commands(spark, tmp_path, capsys):
    source, graph = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    rows = [{"id": f"p{i}", "title": f"Graph paper {i}", "abstract": f"About topic {i}.", "categories": "cs.AI cs.LG", "submitter": "S", "update_date": f"202{i}-01-02", "versions": [{"version": "v1", "created": "Sun, 1 Apr 2007 13:06:50 GMT"}], "authors_parsed": [["Ex", "Ann", ""], [f"Y{i}", "Bo", ""]]} for i in range(4)]
    (source / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    call = lambda *a: (main(["--graph", graph, *a], spark), capsys.readouterr().out)
    assert call("load", str(source), "--checkpoint", str(tmp_path / "mark"))[0] == 0
    assert call("embed")[0] == 0
    status, out = call("validate")
    assert status == 0 and out.count("PASS") == 6
    for command in (["stats"], ["by-author", "ann ex"], ["by-category", "cs.LG"], ["by-year", "2007"], ["fulltext", "graph +about"], ["search", "graph paper 1"], ["by-id", "p1"], ["expand", "p0", "p1"], ["paper-entities", "p1"], ["evaluate"]):
        status, out = call(*command)
        assert status == 0 and "|" in out, command
    extracted = tmp_path / "x"
    extracted.mkdir()
    (extracted / "1.extracted.jsonl").write_text(json.dumps({"paper_id": "p1", "entities": [{"name": "Graph Net", "type": "method"}, {"name": "graph net", "type": "method"}], "extraction_model": "m", "extracted_at": "2024-01-01T00:00:00Z"}))
    assert call("resolve", str(extracted), str(tmp_path / "resolved"))[0] == 0
    assert call("merge", str(tmp_path / "resolved"))[0] == 0
    assert "Graph Net" in call("entities", "method")[1] and "p1" in call("entity-papers", "method", "graph net")[1]
    assert call("export", str(tmp_path / "shards"), "--size", "3")[0] == 0
    assert call("by-category", "zz")[0] == 2
    assert call("index", str(tmp_path / "index"))[0] == 0
    assert call("fulltext", "graph +about", "--index", str(tmp_path / "index"))[1] == call("fulltext", "graph +about")[1]
    assert "4" in call("index-vectors", str(tmp_path / "vectors"))[1]
    assert call("search", "graph paper 1", "--index", str(tmp_path / "vectors"))[1] == call("search", "graph paper 1")[1]
    assert call("generate", str(tmp_path / "eval"))[0] == 0
    record = str(tmp_path / "results.jsonl")
    for command in (["evaluate", "--eval-file", str(tmp_path / "eval"), "--eval-file", str(tmp_path / "nowhere")], ["evaluate-expansion"], ["evaluate-entities"], ["latency", str(tmp_path / "eval"), "--times", "2", "--seeds", "1"]):
        status, out = call(*command, "--record", record)
        assert status == 0 and "|" in out, command
    assert [json.loads(x)["type"] for x in open(record)] == ["retrieval_quality", "graph_expansion_quality", "entity_quality", "system_performance"]
    truth = tmp_path / "truth.jsonl"
    truth.write_text('{"method": [1, 1, 0], "note": "x"}\n\n{"topic": [2, 0, 2]}\n')
    assert "0.5" in call("evaluate-entities", "--truth", str(truth))[1]


def test_extraction_commands(spark, tmp_path, capsys):
    source, graph = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    rows = [{"id": f"p{i}", "title": f"Paper {i}", "abstract": f"We use graph networks and topic model {i} here."} for i in range(7)]
    (source / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    call = lambda *a: (main(["--graph", graph, *a], spark), capsys.readouterr().out)
    status, out = call("ingest-all", str(source), "--checkpoint", str(tmp_path / "mark"))
    assert status == 1 and "FAIL papers_without_authors: 7" in out and "| 7" in out.replace("     7", " 7")
    shards = str(tmp_path / "shards")
    assert call("export", shards, "--size", "3")[0] == 0
    output = f"{shards}/all.extracted.jsonl"
    assert "7" in call("extract", shards, output, "--papers-per-request", "3")[1]
    found = {r.paper_id: [e.name for e in r.entities] for r in spark.read.json(output).collect()}
    assert len(found) == 7 and found["p4"] == ["graph networks", "topic model 4 here"]
    assert "0" in call("extract", shards, output)[1] and spark.read.json(output).count() == 7
    assert "p1" not in call("pending", shards, shards)[1]
    assert call("extract-all", str(tmp_path / "work"))[0] == 0
    assert "graph networks" in call("entities", "topic")[1]

    batch, service = str(tmp_path / "batch"), str(tmp_path / "service")
    assert call("export", batch, "--size", "4")[0] == 0
    assert "batch" in call("batch-submit", batch, "--service", service, "--chunk", "2")[1]
    assert "in_progress" in call("batch-status", batch, "--service", service)[1]
    assert "NULL" in call("batch-collect", batch, "--service", service)[1]
    assert "4" in call("batch-run", batch, "--service", service, "--answer", "--chunk", "2", "--poll", "0")[1]
    assert "p1" not in call("pending", batch, batch)[1]
    assert call("batch-status", str(tmp_path / "in"), "--service", service)[0] == 2
