"""Direct extraction: windows of requests, logs of answers, usage."""

from __future__ import annotations

import json
import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirelake.operators import extraction as X

ENTITY = '{"entities": [{"name": "Net", "type": "method"}]}'


def shard(path, n):
    path.write_text("".join(json.dumps({"arxiv_id": f"p{i:03d}", "title": f"Title {i:03d}", "abstract": "About it."}) + "\n" for i in range(n)))
    return str(path)


def noted(folder, end_at=None, wait=0.0):
    """A client that keeps a file for each call; the call ``end_at`` ends its process."""
    folder.mkdir(exist_ok=True)
    where = str(folder)

    def client(prompt, tokens):
        paper = prompt.split("Title: ")[1][6:9] if "Title: " in prompt else prompt.split("Title ")[1][:3]
        if end_at is not None and paper == end_at:
            os._exit(3)
        time.sleep(wait)
        with open(f"{where}/{paper}", "a") as f:
            f.write("x")
        return X.Answer(ENTITY, 10, 2)

    return client


def calls(folder):
    return {p.name: len(p.read_text()) for p in folder.iterdir()}


def test_a_failed_run_loses_no_answer(spark, tmp_path):
    source, output = shard(tmp_path / "s.jsonl", 90), str(tmp_path / "s.extracted.jsonl")
    asked = tmp_path / "asked"
    with pytest.raises(Exception, match="."):  # the worker ends at paper 57
        X.extract_shard(spark, source, output, noted(asked, "057"), "m")
    before = calls(asked)
    assert before and "057" not in before and not os.path.exists(output)
    answered = {json.loads(x)["ids"][0][1:] for p in Path(f"{output}_log").rglob("*.jsonl") for x in p.read_text().splitlines()}
    assert answered == set(before)
    asked_again = tmp_path / "again"
    assert X.extract_shard(spark, source, output, noted(asked_again), "m") == 90 - len(before)
    again = calls(asked_again)
    assert not set(before) & set(again) and len(before) + len(again) == 90
    rows = spark.read.json(output)
    assert rows.count() == 90 and rows.select("paper_id").distinct().count() == 90 and not os.path.exists(f"{output}_log")
    assert X.usage(spark, output).first().asDict() == {"prompt_tokens": 900, "completion_tokens": 180, "calls": 90}
    assert X.extract_shard(spark, source, output, noted(asked_again), "m") == 0 and calls(asked_again) == again
    assert X.extract_shard(spark, source, output, noted(asked_again), "m", resume=False) == 90
    assert X.usage(spark, output).first().calls == 90


def test_an_attempt_reads_the_log_before(tmp_path):
    """Answers of an attempt that ended are used again, but for a broken last line."""
    log = X._Log(f"file://{tmp_path}", 4)
    for i in range(3):
        log.add({"request": str(i), "answer": "a"})
    part = next((tmp_path / "p=4").iterdir())  # flushed, not closed
    with part.open("a") as f:
        f.write('{"request": "3", "ans')
    assert set(X._Log(f"file://{tmp_path}", 4).before()) == {"0", "1", "2"} and not X._Log(f"file://{tmp_path}", 5).before()
    log.close()


def test_windows_keep_the_order(spark, tmp_path):
    papers = spark.createDataFrame([(f"p{i:03d}", f"Title {i:03d}", "a") for i in range(24)], "arxiv_id string, title string, abstract string").coalesce(1)
    asked = tmp_path / "asked"
    start = time.time()
    rows = X.extract(papers, noted(asked, wait=0.5), "m", window=12).collect()
    assert time.time() - start < 0.5 * 24 and [r.paper_id for r in rows] == [f"p{i:03d}" for i in range(24)]
    assert all(r.entities[0]["name"] == "Net" for r in rows) and calls(asked) == {f"{i:03d}": 1 for i in range(24)}


def test_several_papers_of_a_request_and_failures(spark, tmp_path):
    source, output = shard(tmp_path / "s.jsonl", 5), str(tmp_path / "s.extracted.jsonl")

    def client(prompt, tokens):
        papers = re.findall(r"=== Paper (\d+) ===\s+Title: Title (\d+)", prompt)
        if not papers:
            raise ValueError("no answer")
        return json.dumps({"papers": [{"index": int(i), "entities": [{"name": f"N{title}", "type": "topic"}]} for i, title in papers]})

    assert X.extract_shard(spark, source, output, client, "m", 2, window=3) == 5
    found = {r.paper_id: [e.name for e in r.entities] for r in spark.read.schema("paper_id string, entities array<struct<name: string, type: string>>").json(output).collect()}
    assert found == {f"p{i:03d}": [f"N{i:03d}"] if i < 4 else [] for i in range(5)}
    assert X.usage(spark, output).select(F.col("calls")).first()[0] == 3
    assert X.usage(spark, str(tmp_path / "none")).first().asDict() == {"prompt_tokens": 0, "completion_tokens": 0, "calls": 0}
