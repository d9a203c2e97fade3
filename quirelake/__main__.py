"""Command line over a folder of graph tables: ``python -m quirelake COMMAND ...``.

Retrieval: search, by-id, by-author, by-category, by-year, fulltext, entities,
entity-papers, paper-entities, expand, stats, index, index-add,
index-delete, index-merge, index-vectors.  Ingestion: schema, load, embed,
validate, ingest-all, vacuum, rebucket.  Extraction: export, extract, usage, pending, resolve, merge,
extract-all.  Batches: batch-submit, batch-status, batch-collect, batch-run.
Evaluation: generate, evaluate, evaluate-expansion, evaluate-entities, latency.

A model is named as ``module:function`` and called with (prompt, most tokens); the
default is a stand-in.  A batch service is a folder that requests are put into.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.text import paper_text, preview
from .operators import entities, evaluate, expand, extraction, fulltext, search, stats, vector_index
from .schema import Graph, GraphError
from .session import spark_session
from .sources import metadata, tables
from .streaming import ingest


def parser() -> argparse.ArgumentParser:
    """The commands and their arguments."""
    p = argparse.ArgumentParser(prog="quirelake", description=__doc__)
    p.add_argument("--graph", required=True, help="folder of the graph's versions")
    p.add_argument("--dimension", type=int, default=64, help="of the stand-in encoder")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple[str, dict]) -> None:
        own = sub.add_parser(name)
        for flag, options in arguments:
            own.add_argument(flag, **options)

    limit = ("--limit", {"type": int, "default": 10})
    kind = ("type", {"choices": ["method", "dataset", "topic"]})
    add("load", ("source", {}), ("--checkpoint", {"required": True}), ("--replace-edges", {"action": "store_true"}))
    add("embed", ("--all", {"action": "store_true"}), limit)
    add("validate")
    add("stats")
    add("search", ("query", {}), ("--top-k", {"type": int, "default": 5}), ("--related", {"type": int, "default": 5}), ("--index", {"help": "folder that index-vectors wrote"}))
    add("by-id", ("id", {}), ("--related", {"type": int, "default": 5}))
    add("by-author", ("name", {}), limit)
    add("by-category", ("code", {}), limit)
    add("by-year", ("start", {"type": int}), ("end", {"type": int, "nargs": "?"}), limit)
    add("fulltext", ("query", {}), ("--index", {"help": "folder that index wrote"}), limit)
    add("vacuum", ("--keep", {"type": int, "default": 1}))
    add("rebucket", ("buckets", {"type": int}))
    add("index", ("target", {}))
    add("index-add", ("target", {}), ("ids", {"nargs": "+", "help": "papers that are new or have changed"}))
    add("index-delete", ("target", {}), ("ids", {"nargs": "+"}))
    add("index-merge", ("target", {}))
    add("index-vectors", ("target", {}), ("--cells", {"type": int}))
    add("schema", ("--database", {"default": "default"}))
    add("ingest-all", ("source", {}), ("--checkpoint", {"required": True}), ("--replace-edges", {"action": "store_true"}))
    add("entities", kind, ("--contains", {}), limit)
    add("entity-papers", kind, ("name", {}), limit)
    add("paper-entities", ("id", {}))
    add("expand", ("ids", {"nargs": "+"}), ("--related", {"type": int, "default": 5}), ("--pool", {"type": int, "default": 20}))
    add("export", ("target", {}), ("--size", {"type": int, "default": 1000}))
    add("pending", ("shards", {}), ("extracted", {}))
    model = (("--client", {"default": "quirelake.operators.extraction:phrases_client"}), ("--model", {"default": "stand-in"}))
    per = ("--papers-per-request", {"type": int, "default": 1})
    at_once = ("--window", {"type": int, "default": 1, "help": "requests of a task at a time"})
    add("extract", ("shard", {}), ("output", {}), *model, per, at_once, ("--no-resume", {"action": "store_true"}))
    add("usage", ("output", {}))
    add("resolve", ("extracted", {}), ("target", {}), ("--threshold", {"type": float, "default": entities.THRESHOLD}), ("--acronyms", {"action": "store_true"}))
    add("merge", ("resolved", {}))
    add("extract-all", ("work", {}), *model, per, at_once, ("--threshold", {"type": float, "default": entities.THRESHOLD}))
    service = ("--service", {"required": True, "help": "folder of the batch service"})
    answered = ("--answer", {"action": "store_true", "help": "let the client answer at once"})
    add("batch-submit", ("shards", {}), service, answered, *model, ("--chunk", {"type": int, "default": extraction.CHUNK}))
    add("batch-status", ("shards", {}), service, ("--batch", {}))
    add("batch-collect", ("shards", {}), service, ("--batch", {}), *model)
    add("batch-run", ("shards", {}), service, answered, *model, ("--chunk", {"type": int, "default": extraction.CHUNK}), ("--poll", {"type": float, "default": 60.0}))
    record = ("--record", {"help": "JSON-lines file that the result is added to"})
    add("generate", ("target", {}))
    add("evaluate", ("--cut", {"type": int, "default": 10}), ("--eval-file", {"action": "append", "help": "may be repeated; without one, all titles"}), record)
    add("evaluate-expansion", ("--limit", {"type": int, "default": 500}), ("--cut", {"type": int, "default": 10}), ("--pool", {"type": int, "default": 20}), ("--no-embedding", {"action": "store_true"}), record)
    add("evaluate-entities", ("--truth", {"help": "JSON lines of counts by type"}), record)
    add("latency", ("queries", {}), ("--times", {"type": int, "default": 20}), ("--seeds", {"type": int, "default": 10}), ("--top-k", {"type": int, "default": 10}), record)
    return p


def _client(name: str) -> extraction.Client:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _recorded(df: DataFrame, kind: str, graph: Graph, args: argparse.Namespace) -> DataFrame:
    """``df``, whose few rows are added to the file of results, if there is one."""
    if args.record:
        evaluate.append_result(args.record, {"type": kind, "corpus_size": graph.papers.count(), "rows": [r.asDict() for r in df.collect()]})
    return df


def _extraction(spark: SparkSession, args: argparse.Namespace) -> tuple[list[DataFrame], int] | None:
    """Commands that need no graph: extraction of shards and batches."""
    command = args.command
    if command == "extract":
        n = extraction.extract_shard(spark, args.shard, args.output, _client(args.client), args.model, args.papers_per_request, not args.no_resume, args.window)
        return [spark.createDataFrame([(n,)], "extracted long")], 0
    if command == "usage":
        return [extraction.usage(spark, args.output)], 0
    if not command.startswith("batch-"):
        return None
    service = extraction.FolderService(spark, args.service, _client(args.client) if getattr(args, "answer", False) else None)
    if command == "batch-submit":
        state = extraction.submit(spark, args.shards, service, args.model, args.chunk)
        return [spark.createDataFrame([(state["batch_id"], state["request_count"])] if state else [], "batch string, requests long")], 0
    if command == "batch-status":
        batch = args.batch or extraction.state_of(spark, args.shards)["batch_id"]
        return [spark.createDataFrame([(batch, json.dumps(service.status(batch)))], "batch string, status string")], 0
    if command == "batch-collect":
        n = extraction.collect(spark, args.shards, service, args.batch, args.model)
        return [spark.createDataFrame([(n,)], "collected long")], 0
    return [spark.createDataFrame([(extraction.run(spark, args.shards, service, args.model, args.chunk, args.poll),)], "chunks long")], 0


def _evaluation(spark: SparkSession, g: Graph, args: argparse.Namespace, encoder: V.Encoder) -> list[DataFrame] | None:
    command, dim = args.command, args.dimension
    if command == "generate":
        evaluate.write_eval(evaluate.self_retrieval(g.papers), args.target)
        return []
    if command == "evaluate":
        e = g.embeddings.filter("property = 'embedding'").select(F.xxhash64("arxiv_id").alias("key"), "vector")
        rows = evaluate.read_eval(spark, *args.eval_file) if args.eval_file else evaluate.self_retrieval(g.papers)
        asked = rows.select(F.xxhash64("query", "expected_paper_id", "source").alias("query_id"), F.xxhash64("expected_paper_id").alias("expected"), V.encode_udf(lambda: V.hashing_encoder(dim))("query").alias("vector"), "source")
        return [_recorded(evaluate.retrieval(asked, e, args.cut), "retrieval_quality", g, args)]
    if command == "evaluate-expansion":
        cases = evaluate.expansion_cases(g, args.limit)
        return [_recorded(evaluate.expansion(g, cases, args.cut, args.pool, not args.no_embedding), "graph_expansion_quality", g, args)]
    if command == "evaluate-entities":
        rated = [evaluate.precision_recall(evaluate.read_counts(spark, args.truth))] if args.truth else []
        return [*rated, _recorded(evaluate.resolution_score(g.entities, evaluate.synonym_pairs(spark)), "entity_quality", g, args)]
    if command == "latency":
        queries = [r.query for r in evaluate.read_eval(spark, args.queries).limit(args.times).collect()]
        taken = evaluate.workload(g, encoder, queries, args.top_k, args.seeds)
        df = spark.createDataFrame([(name, t["n"], t["p50"], t["p95"], t["mean"]) for name, t in taken.items()], "operation string, n long, p50 double, p95 double, mean double")
        return [_recorded(df, "system_performance", g, args)]
    return None


def _resolved(spark: SparkSession, extracted: str, target: str, threshold: float, dim: int, acronyms: bool = False) -> None:
    rows = entities.resolve(entities.read_extractions(spark, extracted), V.encode_udf(lambda: V.hashing_encoder(dim)), threshold, acronyms=acronyms)
    rows.drop("seq").write.mode("overwrite").json(target)


def _merged(spark: SparkSession, g: Graph, path: str, resolved: str) -> DataFrame:
    rows = entities.read_resolved(spark, resolved)
    tables.put(spark, path, entities.resolved_rows(g, rows))
    return entities.sent(rows)


def _embedded(spark: SparkSession, path: str, dim: int, every: bool = False) -> None:
    g = ingest.current(spark, path)
    papers = metadata.eligible(g.papers) if every else metadata.missing_embedding(g.papers, g.embeddings)
    encode = V.encode_udf(lambda: V.hashing_encoder(dim))
    new = papers.select("arxiv_id", F.lit("embedding").alias("property"), encode(paper_text("title", "abstract")).alias("vector"), F.lit("hashing").alias("model"))
    tables.put(spark, path, Graph(embeddings=new))


def _validated(g: Graph) -> int:
    lines, passed = stats.report(stats.validate(g).collect())
    print("\n".join(lines))
    return 0 if passed else 1


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[list[DataFrame], int]:
    """The results of a command, to be shown, and its exit status."""
    path, command = args.graph, args.command
    if (found := _extraction(spark, args)) is not None:
        return found
    if command == "schema":
        stats.create_tables(spark, args.database)
        return [], 0
    if command == "ingest-all":
        n = ingest.ingest(spark, args.source, path, args.checkpoint, args.replace_edges)
        _embedded(spark, path, args.dimension)
        return [spark.createDataFrame([(n,)], "loaded long")], _validated(ingest.current(spark, path))
    if command == "load":
        n = ingest.ingest(spark, args.source, path, args.checkpoint, args.replace_edges)
        return [spark.createDataFrame([(n,)], "loaded long")], 0
    g = ingest.current(spark, path)
    encoder = V.hashing_encoder(args.dimension)
    if command == "vacuum":
        return [spark.createDataFrame([(tables.vacuum(spark, path, args.keep),)], "buckets long")], 0
    if command == "rebucket":
        return [spark.createDataFrame([(tables.rebucket(spark, path, args.buckets),)], "version long")], 0
    if command == "embed":
        _embedded(spark, path, args.dimension, args.all)
        return [spark.createDataFrame([("embedded",)], "done string")], 0
    if command == "validate":
        return [], _validated(g)
    if (evaluated := _evaluation(spark, g, args, encoder)) is not None:
        return evaluated, 0
    if command == "index":
        fulltext.write_index(g.papers, args.target)
        return [], 0
    if command in ("index-add", "index-delete"):
        named = g.papers.filter(F.col("arxiv_id").isin(args.ids))
        (fulltext.add_docs if command == "index-add" else fulltext.delete_docs)(named if command == "index-add" else spark.createDataFrame([(i,) for i in args.ids], "arxiv_id string"), args.target)
        return [], 0
    if command == "index-merge":
        fulltext.merge_segments(spark, args.target)
        fulltext.vacuum_index(spark, args.target)
        return [], 0
    if command == "index-vectors":
        vectors = g.embeddings.filter("property = 'embedding'").select(F.col("arxiv_id").alias("key"), "vector")
        index = vector_index.write(vectors, args.target, args.cells)
        return [spark.createDataFrame([(len(index.cells), int(index.rows.sum()))], "cells long, vectors long")], 0
    if command == "fulltext" and args.index:
        return [fulltext.search_index(*fulltext.read_index(spark, args.index), args.query, limit=args.limit)], 0
    if command == "search":
        vector = V.encode_query(encoder, args.query)
        index = vector_index.read(spark, args.index) if args.index else None
        return list(expand.search_and_expand(g, vector, args.top_k, index, related_limit=args.related)), 0
    if command == "by-id":
        return [search.paper_detail(g, args.id), *expand.expand_paper(g, args.id, related_limit=args.related)], 0
    if command == "export":
        metadata.write_shards(metadata.export_papers(g.papers), args.target, args.size)
        return [], 0
    if command == "pending":
        return [extraction.pending(spark, args.shards, args.extracted)], 0
    if command == "resolve":
        _resolved(spark, args.extracted, args.target, args.threshold, args.dimension, args.acronyms)
        return [], 0
    if command == "merge":
        return [_merged(spark, g, path, args.resolved)], 0
    if command == "extract-all":
        metadata.write_shards(metadata.export_papers(g.papers), f"{args.work}/shards")
        extraction.extract_shard(spark, f"{args.work}/shards", f"{args.work}/all.extracted.jsonl", _client(args.client), args.model, args.papers_per_request, window=args.window)
        _resolved(spark, args.work, f"{args.work}/resolved", args.threshold, args.dimension)
        return [_merged(spark, g, path, f"{args.work}/resolved")], 0
    short = lambda df: df.withColumn("abstract", preview("abstract")) if "abstract" in df.columns else df
    found = {
        "stats": lambda: stats.corpus_stats(g),
        "by-author": lambda: search.papers_by_author(g, args.name, args.limit),
        "by-category": lambda: short(search.papers_by_category(g, args.code, args.limit, check=True)),
        "by-year": lambda: short(search.papers_by_year(g, args.start, args.end, args.limit)),
        "fulltext": lambda: fulltext.search(g.papers, args.query, limit=args.limit),
        "entities": lambda: entities.list_entities(g, args.type, args.contains, args.limit),
        "entity-papers": lambda: entities.papers_for_entity(g, args.type, args.name, args.limit, check=True),
        "paper-entities": lambda: entities.paper_entities(g, args.id),
        "expand": lambda: expand.expand(g, args.ids, related_limit=args.related, pool_size=args.pool),
    }[command]()
    return list(found) if isinstance(found, tuple) else [found], 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        results, status = run(spark or spark_session(), args)
    except GraphError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    for df in results:
        df.show(100, truncate=80)
    return status


if __name__ == "__main__":
    sys.exit(main())
