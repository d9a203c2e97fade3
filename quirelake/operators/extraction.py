"""Extraction of entities by a model: directly, and through a batch service.

A client is a callable (prompt, most tokens) -> answer that can be sent to workers and
called by several threads; a service keeps a batch's requests until it has answers.  Both are passed in.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from typing import NamedTuple, Protocol

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import GraphError
from ..scratch import dropped, written
from ..sources import files
from ..sources.metadata import read_mark, shard_numbers, write_mark
from .entities import batch_requests, batch_results, needs_extraction, read_papers, read_shards, token_usage

Client = Callable[[str, int], "str | Answer"]
#: Tokens of an answer: for each paper, and in all.
PAPER_TOKENS, MOST_TOKENS = 512, 4096
#: Papers of one batch of a service, and answers of one file of a task's log (1 where a
#: store shows what is written only when the file is closed).
CHUNK, SEGMENT = 1500, 100
LOGGED = "request string, ids array<string>, extraction_model string, answer string, input_tokens long, output_tokens long, extracted_at string"


def phrases_client(prompt: str, max_tokens: int) -> str:
    """A deterministic stand-in for a model: a prompt's candidate phrases as topics."""
    found = [[p.strip() for p in m.split(",") if p.strip()] for m in re.findall(re.escape(T.HINT) + "(.*)", prompt)]
    listed = [[{"name": p, "type": "topic"} for p in own] for own in found]
    if not prompt.startswith("=== Paper"):
        return json.dumps({"entities": listed[0] if listed else []})
    papers = re.split(r"^=== Paper (\d+) ===$", prompt, flags=re.M)[1:]
    return json.dumps({"papers": [{"index": int(i), "entities": json.loads(phrases_client("Title:" + text, max_tokens))["entities"]} for i, text in zip(papers[::2], papers[1::2], strict=True)]})


class Answer(NamedTuple):
    """A client's answer with what it used; a client may give the text alone."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0


def _requests(papers: DataFrame, per_request: int) -> DataFrame:
    """(ids, prompt, tokens): ``per_request`` papers in a prompt, in order of id."""
    hinted = papers.select("arxiv_id", "title", "abstract", T.candidate_phrases("abstract").alias("candidates"))
    if per_request == 1:
        return hinted.select(F.array("arxiv_id").alias("ids"), T.user_prompt("title", "abstract", "candidates").alias("prompt"), F.lit(PAPER_TOKENS).alias("tokens"))
    grouped = shard_numbers(hinted, per_request).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("arxiv_id", "title", "abstract", "candidates"))).alias("p"))
    own = F.transform("p", lambda x: x["arxiv_id"])
    # one paper alone gets the prompt for one
    alone = T.user_prompt(F.col("p")[0]["title"], F.col("p")[0]["abstract"], F.col("p")[0]["candidates"])
    return grouped.select(own.alias("ids"), F.when(F.size("p") == 1, alone).otherwise(T.batch_prompt(F.col("p"))).alias("prompt"), F.least(F.size("p") * PAPER_TOKENS, F.lit(MOST_TOKENS)).alias("tokens"))


def _asked(client: Client, prompt: str, tokens: int) -> Answer:
    try:
        found = client(prompt, tokens)
    except Exception:  # noqa: BLE001  a model's failure is an empty answer
        return Answer("")
    return found if isinstance(found, Answer) else Answer(found)


class _Log:
    """A task's answers as JSON lines in a folder of its partition: each is flushed as
    it is written, and a file has ``SEGMENT`` of them at most."""

    def __init__(self, uri: str, partition: int):
        self.fs, where = fs.FileSystem.from_uri(uri)
        self.folder, self.stream, self.left = f"{where}/p={partition}", None, 0
        self.fs.create_dir(self.folder, recursive=True)

    def before(self) -> dict[str, dict]:
        """What earlier attempts of this task have been answered, by request."""
        found = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            with self.fs.open_input_stream(info.path) as file:
                for line in file.read().decode(errors="replace").split("\n"):
                    try:
                        row = json.loads(line)
                        found[row["request"]] = row
                    except ValueError:  # the last line of an attempt that ended in it
                        continue
        return found

    def add(self, row: dict) -> None:
        if not self.left:
            self.close()
            self.stream, self.left = self.fs.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl"), SEGMENT
        self.stream.write(json.dumps(row).encode() + b"\n")
        self.stream.flush()
        self.left -= 1

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()


def _asker(client: Client, window: int, model: str, log: str | None):
    """Asks a task's requests, ``window`` of them at a time; answers come in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Log(log, TaskContext.get().partitionId()) if log else None
        known = own.before() if own else {}
        with ThreadPoolExecutor(window) as pool:
            try:
                for part in batches:
                    waiting: deque = deque()
                    rows: list[dict] = []

                    def next_answer(waiting=waiting, rows=rows) -> None:
                        row, answer = waiting.popleft()
                        if answer is not None:
                            found = answer.result()
                            row |= {"answer": found.text, "input_tokens": found.input_tokens, "output_tokens": found.output_tokens, "extracted_at": datetime.now(UTC).isoformat(timespec="seconds")}
                            if own:
                                own.add(row)
                        rows.append(row)

                    for ids, prompt, tokens in zip(part["ids"], part["prompt"], part["tokens"], strict=True):
                        ids = [str(x) for x in ids]
                        request = hashlib.sha256("\n".join(ids).encode()).hexdigest()
                        if request in known:
                            waiting.append((known[request], None))
                        else:
                            waiting.append(({"request": request, "ids": ids, "extraction_model": model}, pool.submit(_asked, client, prompt, int(tokens))))
                        if len(waiting) >= window:
                            next_answer()
                    while waiting:
                        next_answer()
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in LOGGED.split(", ")])
            finally:
                if own:
                    own.close()

    return run


def _rows_of(answers: DataFrame, per_request: int) -> DataFrame:
    """Extraction rows of answers (ids, answer, extraction_model, extracted_at); an
    answer in no usable form gives no entities."""
    several = T.parse_batch_entities("answer", per_request)
    entities = F.when(F.size("ids") == 1, F.array(T.parse_entities("answer"))).otherwise(several)
    each = answers.withColumn("entities", entities).select(F.posexplode("ids").alias("i", "paper_id"), "entities", "extraction_model", "extracted_at")
    return each.select("paper_id", F.get("entities", F.col("i")).alias("entities"), "extraction_model", "extracted_at")


def extract(papers: DataFrame, client: Client, model: str, per_request: int = 1, window: int = 1) -> DataFrame:
    """Extraction rows of ``papers`` (arxiv_id, title, abstract) in order of id, with
    ``per_request`` papers in a prompt and ``window`` requests of a task at a time.
    What the client can't do, or answers in no usable form, gives no entities."""
    kind = papers.schema["arxiv_id"].dataType
    told = _requests(papers, per_request).mapInPandas(_asker(client, window, model, None), LOGGED)
    rows = _rows_of(told, per_request)
    return rows.withColumn("paper_id", F.col("paper_id").cast(kind)).orderBy("paper_id")


def _commit(spark: SparkSession, output: str, log: str, per_request: int) -> int:
    """Puts the log's answers into ``output``, those of papers that it doesn't have, and
    what they used beside it; how many papers."""
    if not any(files.names(spark, f"{log}/{p}") for p in files.names(spark, log)):
        return 0
    lines = spark.read.text(f"{log}/*/*.jsonl").select(F.from_json("value", LOGGED).alias("r")).select("r.*").filter(F.col("request").isNotNull() & F.col("answer").isNotNull())
    answers = written(lines.dropDuplicates(["request"]), "answers")
    for target, found, key in ((f"{output}_usage", answers.select("request", F.size("ids").alias("papers"), "extraction_model", "input_tokens", "output_tokens"), "request"), (output, _rows_of(answers, per_request), "paper_id")):
        if files.exists(spark, target):
            found = found.join(spark.read.schema(f"{key} string").json(target), key, "left_anti")
        if target == output:
            found = written(found.dropDuplicates(["paper_id"]), "extracted")
            n = found.count()
        found.sortWithinPartitions(key).write.mode("append").json(target)
    dropped(answers, found)
    files.delete(spark, log)
    return n


def extract_shard(spark: SparkSession, shard: str, output: str, client: Client, model: str, per_request: int = 1, resume: bool = True, window: int = 1) -> int:
    """Appends the extraction rows of a shard's papers to ``output``, a folder named
    ``*.extracted.jsonl``; how many papers were asked about.

    Each task asks ``window`` requests at a time and logs every answer as it comes in
    ``<output>_log``; an attempt that is run again reads the log of the one before.  The
    log is put into ``output`` at the end, or when the next call begins, so a run that
    fails loses no answer.  With ``resume`` papers that ``output`` has are left out,
    else it is begun anew.
    """
    log = f"{output}_log"
    if not resume:
        for old in (log, output, f"{output}_usage"):
            files.delete(spark, old)
    _commit(spark, output, log, per_request)
    left = read_shards(spark, shard).dropDuplicates(["arxiv_id"])
    if files.exists(spark, output):
        left = left.join(spark.read.schema("paper_id string").json(output).select(F.col("paper_id").alias("arxiv_id")), "arxiv_id", "left_anti")
    asked = written(_requests(left, per_request), "requests")
    if asked.limit(1).count():
        where = files.qualified(spark, log)
        asked.mapInPandas(_asker(client, window, model, where), LOGGED).write.format("noop").mode("overwrite").save()
    dropped(asked)
    return _commit(spark, output, log, per_request)


def usage(spark: SparkSession, output: str) -> DataFrame:
    """(prompt_tokens, completion_tokens, calls) of all requests that ``output`` is
    made of, each once however often its task was run."""
    kinds = "request string, input_tokens long, output_tokens long"
    rows = spark.read.schema(kinds).json(f"{output}_usage") if files.exists(spark, f"{output}_usage") else spark.createDataFrame([], kinds)
    return token_usage(rows.dropDuplicates(["request"]).select(F.col("input_tokens").alias("prompt_tokens"), F.col("output_tokens").alias("completion_tokens")))


class BatchService(Protocol):
    """What answers a batch's requests later on."""

    def create(self, requests: DataFrame) -> str:
        """Takes requests (value: JSON lines); the batch's id."""

    def status(self, batch: str) -> dict:
        """status ("completed", "failed", "expired", "cancelled" or another), and counts."""

    def results(self, batch: str) -> DataFrame | None:
        """A completed batch's answers (value: JSON lines), if it has any."""


class FolderService:
    """A service that is a folder: ``<id>/requests`` is written, and whoever answers
    writes ``<id>/results``.  With a client it answers at once."""

    def __init__(self, spark: SparkSession, path: str, client: Client | None = None):
        self.spark, self.path, self.client = spark, path, client

    def create(self, requests: DataFrame) -> str:
        batch = uuid.uuid4().hex[:12]
        requests.select("value").write.text(f"{self.path}/{batch}/requests")
        if self.client is not None:
            client = self.client

            def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for part in batches:
                    out = []
                    for line in part["value"]:
                        r = json.loads(line)
                        content = client(r["body"]["messages"][-1]["content"], r["body"]["max_tokens"])
                        out.append(json.dumps({"custom_id": r["custom_id"], "response": {"status_code": 200, "body": {"choices": [{"message": {"content": content}}]}}}))
                    yield pd.DataFrame({"value": out})

            self.spark.read.text(f"{self.path}/{batch}/requests").mapInPandas(answer, "value string").write.text(f"{self.path}/{batch}/results")
        return batch

    def status(self, batch: str) -> dict:
        if not files.exists(self.spark, f"{self.path}/{batch}/requests"):
            return {"status": "failed", "total": 0, "completed": 0}
        done = files.exists(self.spark, f"{self.path}/{batch}/results/_SUCCESS")
        total = self.spark.read.text(f"{self.path}/{batch}/requests").count()
        return {"status": "completed" if done else "in_progress", "total": total, "completed": total if done else 0}

    def results(self, batch: str) -> DataFrame | None:
        return self.spark.read.text(f"{self.path}/{batch}/results") if files.exists(self.spark, f"{self.path}/{batch}/results") else None


def pending(spark: SparkSession, shards: str, extracted: str | None = None) -> DataFrame:
    """The papers below ``shards`` that need extraction, by id."""
    papers = read_shards(spark, shards).withColumn("seq", F.monotonically_increasing_id())
    return needs_extraction(papers, read_papers(spark, extracted or shards)).orderBy("arxiv_id")


def submit(spark: SparkSession, shards: str, service: BatchService, model: str, chunk: int = CHUNK) -> dict | None:
    """Gives the service the first ``chunk`` papers that need extraction; the batch's
    state, which is kept beside the shards, or None if no paper needs any."""
    left = pending(spark, shards).limit(chunk)
    n = left.count()
    if not n:
        return None
    state = {"batch_id": service.create(batch_requests(left, model)), "model": model, "request_count": n}
    write_mark(spark, f"{shards}/batch_state.json", state)
    return state


def state_of(spark: SparkSession, shards: str) -> dict:
    """The state that the last ``submit`` kept."""
    found = read_mark(spark, f"{shards}/batch_state.json")
    if found is None:
        raise GraphError("NO_BATCH", f"no batch was submitted from {shards}")
    return found


def collect(spark: SparkSession, shards: str, service: BatchService, batch: str | None = None, model: str | None = None) -> int | None:
    """Writes a completed batch's answers beside the shards, as extraction rows; how
    many, or None while it isn't completed or without answers."""
    state = state_of(spark, shards) if batch is None else {}
    batch = batch or state["batch_id"]
    answers = service.results(batch) if service.status(batch)["status"] == "completed" else None
    if answers is None:
        return None
    target = f"{shards}/batch_recovery_{batch}.extracted.jsonl"
    batch_results(answers, state.get("model") or model or "unknown").write.mode("overwrite").json(target)
    return spark.read.text(target).count()


def run(spark: SparkSession, shards: str, service: BatchService, model: str, chunk: int = CHUNK, poll: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Submits, waits and collects, one chunk after the other, until no paper needs
    extraction, a batch fails, or one brings nothing new; how many chunks there were."""
    chunks, before = 0, -1
    while True:
        left = pending(spark, shards).count()
        if left == 0 or left == before:
            return chunks
        before = left
        state = submit(spark, shards, service, model, chunk)
        chunks += 1
        while (status := service.status(state["batch_id"])["status"]) not in ("completed", "failed", "expired", "cancelled"):
            sleep(poll)
        if status != "completed":
            raise GraphError("BATCH_FAILED", f"batch {state['batch_id']} ended as {status}")
        collect(spark, shards, service)
