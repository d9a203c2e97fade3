"""Extracted entities: reads, merges, and their resolution."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import Encoder
from ..schema import ENTITY_TYPES, Graph, GraphError
from ..sources.metadata import upsert
from .clusters import THRESHOLD, cluster, greedy_clusters

__all__ = ["THRESHOLD", "cluster", "greedy_clusters"]

_PAPER = "paper_id string, entities array<struct<name: string, type: string>>, extraction_model string, extracted_at string"


def check_type(entity_type: str) -> str:
    if entity_type not in ENTITY_TYPES:
        raise GraphError("UNKNOWN_ENTITY_TYPE", entity_type)
    return entity_type


def paper_entities(graph: Graph, arxiv_id=None) -> DataFrame:
    """Papers with a list of (name, confidence) for each type, sorted; a paper without
    entities stays, with empty lists."""
    papers = graph.papers if arxiv_id is None else graph.papers.filter(F.col("arxiv_id") == arxiv_id)
    own = graph.mentions if arxiv_id is None else graph.mentions.filter(F.col("arxiv_id") == arxiv_id)
    named = own.join(graph.entities, ["entity_type", "normalized_name"])
    lists = [F.array_sort(F.collect_list(F.when(F.col("entity_type") == t, F.struct("name", "confidence")))).alias(f"{t}s") for t in ENTITY_TYPES]
    none = F.array().cast("array<struct<name: string, confidence: double>>")
    found = papers.select("arxiv_id").join(named.groupBy("arxiv_id").agg(*lists), "arxiv_id", "left")
    return found.select("arxiv_id", *(F.coalesce(f"{t}s", none).alias(f"{t}s") for t in ENTITY_TYPES))


def list_entities(graph: Graph, entity_type: str, query: str | None = None, limit: int = 50) -> DataFrame:
    """(name, normalized_name) of a type's entities by name, those whose name contains
    ``query`` in any case if it is given."""
    if limit > 200:
        raise GraphError("LIMIT_TOO_LARGE", "limit is at most 200")
    found = graph.entities.filter(F.col("entity_type") == check_type(entity_type))
    if query is not None:
        found = found.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    return found.select("name", "normalized_name").orderBy("name", "normalized_name").limit(limit)


def papers_for_entity(graph: Graph, entity_type: str, normalized_name: str, limit: int = 10, check: bool = False) -> DataFrame:
    """(arxiv_id, title, confidence) of papers that mention the entity, most confident
    first; with ``check`` an unknown entity is an error."""
    if limit > 200:
        raise GraphError("LIMIT_TOO_LARGE", "limit is at most 200")
    same = (F.col("entity_type") == check_type(entity_type)) & (F.col("normalized_name") == normalized_name)
    if check and graph.entities.filter(same).isEmpty():
        raise GraphError("ENTITY_NOT_FOUND", normalized_name)
    own = graph.mentions.filter(same).select("arxiv_id", "confidence")
    return graph.papers.select("arxiv_id", "title").join(own, "arxiv_id").orderBy(F.desc_nulls_first("confidence"), "arxiv_id").limit(limit)


def last_mention(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row for each paper and entity, the last by ``seq``; without a confidence
    it is 1."""
    rest = ["confidence", "extraction_model", "extracted_at", "raw_name"]
    last = rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0))).groupBy("arxiv_id", "entity_type", "normalized_name").agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return last.select("arxiv_id", "entity_type", "normalized_name", *(F.col(f"r.{c}").alias(c) for c in rest))


def resolved_rows(graph: Graph, rows: DataFrame, seq: str = "seq") -> Graph:
    """The entities and mentions that resolved mentions put into ``graph``: an entity
    has the last name of its rows, and an edge, both of whose ends must exist, its last
    row."""
    entities = rows.groupBy("entity_type", "normalized_name").agg(F.max_by("name", seq).alias("name"))
    mentions = last_mention(rows, seq).join(graph.papers.select("arxiv_id"), "arxiv_id", "left_semi")
    return Graph(entities=entities, mentions=mentions.select(*graph.mentions.columns))


def sent(rows: DataFrame) -> DataFrame:
    """The counts (entity_type, entities, mentions) of resolved mentions."""
    return rows.groupBy("entity_type").agg(F.countDistinct("normalized_name").alias("entities"), F.count(F.lit(1)).alias("mentions"))


def merge_resolved(graph: Graph, rows: DataFrame, seq: str = "seq") -> tuple[Graph, DataFrame]:
    """``graph`` with resolved mentions put in, and the counts of what was sent.  An
    entity that is there keeps its own name."""
    new = resolved_rows(graph, rows, seq)
    return Graph(**{**graph.tables(), "entities": upsert(graph.entities, new.entities, "entities", ("name",)), "mentions": upsert(graph.mentions, new.mentions, "mentions")}), sent(rows)


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """(seq, paper_id, name, entity_type, extraction_model, extracted_at) of every
    extracted entity in ``*.extracted.jsonl`` below ``path``, in order of file, line
    and place; repeated papers are all kept."""
    return mentions_of(read_papers(spark, path))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(at, paper_id, entities, extraction_model, extracted_at): a row for each line of
    what is named ``*.extracted.jsonl`` in the folder ``path``, files or folders of
    files; ``at`` orders them by file and line."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*.extracted.jsonl")
    if not list(where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []):
        rows = spark.createDataFrame([], f"at struct<file: string, line: bigint>, {_PAPER}")
        return rows
    rows = spark.read.schema(_PAPER).json(f"{path}/*.extracted.jsonl")
    return rows.select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"), "*")


_RESOLVED = "paper_id string, entity_type string, name string, normalized_name string, raw_name string, extraction_model string, extracted_at string"


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """Resolved mentions of JSON lines, as ``merge_resolved`` takes them."""
    rows = spark.read.schema(_RESOLVED).json(path)
    return rows.select(F.col("paper_id").alias("arxiv_id"), "entity_type", "normalized_name", "name", "raw_name", F.lit(None).cast("double").alias("confidence"), "extraction_model", F.try_to_timestamp("extracted_at").alias("extracted_at"), F.monotonically_increasing_id().alias("seq"))


def mentions_of(*parts: DataFrame) -> DataFrame:
    """The mentions of papers' extractions, of all parts with all repeats: each has a
    (file, line) ``at``, which with the place in the line becomes ``seq``."""
    rows = reduce(DataFrame.unionByName, parts)
    each = rows.select("at", "paper_id", "extraction_model", "extracted_at", F.posexplode("entities").alias("place", "e"))
    return each.select(F.struct("at.file", "at.line", "place").alias("seq"), "paper_id", F.trim("e.name").alias("name"), F.col("e.type").alias("entity_type"), "extraction_model", "extracted_at")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id, title, abstract) of a shard file, or of a folder's shards: files or
    folders of files, without the extractor's own."""
    ddl = "arxiv_id string, title string, abstract string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(where).isDirectory():
        return spark.read.schema(ddl).json(path)
    own = [str(s.getPath()) for s in fs.listStatus(where) if re.fullmatch(r"shard(_\d+\.jsonl|=\d+)", s.getPath().getName())]
    return spark.read.schema(ddl).json(own) if own else spark.createDataFrame([], ddl)


def needs_extraction(shards: DataFrame, extracted: DataFrame, key: str = "arxiv_id", seq: str = "seq") -> DataFrame:
    """The first copy of each paper that was never extracted, or only without any
    entity."""
    done = extracted.filter(F.size("entities") > 0).select(F.col("paper_id").alias(key))
    rest = [c for c in shards.columns if c not in (key, seq)]
    left = shards.join(done, key, "left_anti").groupBy(key).agg(F.min_by(F.struct(seq, *rest), seq).alias("r"))
    return left.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def name_counts(mentions: DataFrame, seq: str = "seq") -> DataFrame:
    """(entity_type, name, n, first): how often each name occurs, and where first."""
    return mentions.groupBy("entity_type", "name").agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))


def expanded(names: DataFrame) -> DataFrame:
    """(entity_type, name, expansion) of the acronyms among ``names`` (entity_type, name,
    n, first): two to six capitals that are the initials of another name's words, the
    most frequent of those, then the first.  A plural's s may follow."""
    word = F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    initials = F.array_join(F.transform(word, lambda x: F.substring(x, 1, 1)), "")
    full = names.filter(F.size(word) >= 2).groupBy("entity_type", initials.alias("letters")).agg(F.min_by("name", F.struct(-F.col("n"), F.col("first"), F.col("name"))).alias("expansion"))
    short = names.filter(F.col("name").rlike(r"^\p{Lu}{2,6}s?$")).select("entity_type", "name", F.lower(F.regexp_extract("name", r"^(\p{Lu}+)", 1)).alias("letters"))
    return short.join(full, ["entity_type", "letters"]).select("entity_type", "name", "expansion")


def resolve(mentions: DataFrame, encode: Callable | DataFrame, threshold: float = THRESHOLD, seq: str = "seq", acronyms: bool = False) -> DataFrame:
    """``mentions`` (seq, paper_id, name, entity_type, ...) with their canonical names:
    one row for each.  ``encode`` is a column function from names to vectors, or a table
    (name, vector) of stored ones, which must have all names.

    With ``acronyms``, an extension, an acronym joins its expansion's cluster, and so
    does all that joined the acronym."""
    names = name_counts(mentions, seq)
    names = names.join(encode, "name") if isinstance(encode, DataFrame) else names.withColumn("vector", encode("name"))
    found = cluster(names, "entity_type", [-F.col("n"), F.col("first"), F.col("name")], "name", "vector", threshold)
    if acronyms:
        longer = expanded(names).join(found.withColumnRenamed("name", "expansion").withColumnRenamed("canonical", "whole"), ["entity_type", "expansion"]).select("entity_type", F.col("name").alias("canonical"), "whole")
        found = found.join(longer, ["entity_type", "canonical"], "left").select("entity_type", "name", F.coalesce("whole", "canonical").alias("canonical"))
    return mentions.join(found, ["entity_type", "name"]).select("paper_id", "entity_type", F.col("canonical").alias("name"), T.normalize_entity("canonical").alias("normalized_name"), F.col("name").alias("raw_name"), "extraction_model", "extracted_at", seq)


def batch_requests(papers: DataFrame, model: str, max_tokens: int = 512) -> DataFrame:
    """(value): a JSON request for each paper, for a batch service."""
    prompt = T.user_prompt("title", "abstract", T.candidate_phrases("abstract"))
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"), F.lit(max_tokens).alias("max_tokens"))
    return papers.select(F.to_json(F.struct(F.col("arxiv_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def batch_results(lines: DataFrame, model: str) -> DataFrame:
    """Extraction rows of a batch service's JSON lines (value): one for each, without
    entities where the status isn't 200 or the answer isn't usable."""
    row = F.from_json("value", "custom_id string, response struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>>>>>")
    answer = F.when(row["response"]["status_code"] == 200, F.get(row["response"]["body"]["choices"], F.lit(0))["message"]["content"])
    return lines.select(row["custom_id"].alias("paper_id"), T.parse_entities(answer).alias("entities"), F.lit(model).alias("extraction_model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("extracted_at"))


def extract_until_done(shards: DataFrame, read: Callable[[], DataFrame], submit: Callable[[DataFrame], None], passes: int = 10) -> int:
    """Passes of extraction until nothing is left, or a pass leaves as many as before."""
    before = -1
    for done in range(passes):
        left = needs_extraction(shards, read())
        n = left.count()
        if n == 0 or n == before:
            return done
        before = n
        submit(left)
    return passes


def token_usage(calls: DataFrame) -> DataFrame:
    """(prompt_tokens, completion_tokens, calls) in all."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(total("prompt_tokens"), total("completion_tokens"), F.count(F.lit(1)).alias("calls"))
