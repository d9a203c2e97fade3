"""Look-ups by id, author, category and year, and by vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import normalize_name
from ..schema import Graph, GraphError
from . import vector_index as VI


def _limit(name: str, value: int, most: int) -> int:
    if value > most:
        raise GraphError("LIMIT_TOO_LARGE", f"{name} is at most {most}")
    return value


def _newest(df: DataFrame, by: str, limit: int) -> DataFrame:
    """The first rows by date, latest first and unknown dates before them, then by id."""
    return df.orderBy(F.desc_nulls_first(by), "arxiv_id").limit(limit)


def summary(papers: DataFrame, score: Column | None = None, matched_by: Column | None = None) -> DataFrame:
    """(arxiv_id, title, abstract, score, matched_by), typed nulls for what there isn't."""
    return papers.select("arxiv_id", "title", "abstract", (F.lit(None).cast("double") if score is None else score).alias("score"), (F.lit(None).cast("string") if matched_by is None else matched_by).alias("matched_by"))


def paper_by_id(graph: Graph, arxiv_id) -> DataFrame:
    """The paper's row with its embedding, null without one; no row if unknown."""
    paper = graph.papers.filter(F.col("arxiv_id") == arxiv_id)
    if graph.embeddings is None:
        return paper
    own = graph.embeddings.filter(F.col("arxiv_id") == arxiv_id).select("arxiv_id", F.col("vector").alias("embedding"))
    return paper.join(own, "arxiv_id", "left")


def paper_embedding(graph: Graph, arxiv_id, name: str = "embedding") -> DataFrame:
    """(arxiv_id, vector, model) of one paper."""
    return graph.embeddings.filter((F.col("arxiv_id") == arxiv_id) & (F.col("property") == name)).select("arxiv_id", "vector", "model")


def papers_by_author(graph: Graph, name: str, limit: int = 10) -> DataFrame:
    """Papers with an author whose normalised name contains that of ``name``: once
    for each matching display name, newest first.  An empty name matches all."""
    _limit("limit", limit, 100)
    authors = graph.authors.filter(F.contains("normalized_name", F.lit(normalize_name(name)))).select("author_id", F.col("display_name").alias("author_name"))
    edges = graph.authored.select("author_id", "arxiv_id").join(authors, "author_id").select("arxiv_id", "author_name").distinct()
    found = edges.join(graph.papers.select("arxiv_id", "title", "abstract", "update_date"), "arxiv_id")
    return found.orderBy(F.desc_nulls_first("update_date"), "arxiv_id", "author_name").limit(limit)


def category_exists(graph: Graph, code: str) -> DataFrame:
    """(exists): one row."""
    return graph.in_category.filter(F.col("code") == code).limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))


def papers_by_category(graph: Graph, code: str, limit: int = 10, check: bool = False) -> DataFrame:
    """Papers in the category, primary or not, newest first; with ``check`` an unknown
    code is an error."""
    _limit("limit", limit, 100)
    if check and not category_exists(graph, code).first()[0]:
        raise GraphError("CATEGORY_NOT_FOUND", code)
    members = graph.in_category.filter(F.col("code") == code).select("arxiv_id")
    return _newest(graph.papers.join(members, "arxiv_id", "left_semi"), "update_date", limit)


def papers_by_year(graph: Graph, start: int, end: int | None = None, limit: int = 10) -> DataFrame:
    """Papers first submitted in the years from ``start`` to ``end``, newest first;
    matched_by is the year.  The years become a range, which reaches the scan."""
    _limit("limit", limit, 100)
    end = start if end is None else end
    if end < start:
        raise GraphError("INVALID_YEAR_RANGE", f"{start} to {end}")
    kind = graph.papers.schema["first_submitted_at"].dataType.simpleString()
    at = F.col("first_submitted_at")
    found = graph.papers.filter((at >= F.lit(f"{start:04d}-01-01 00:00:00").cast(kind)) & (at < F.lit(f"{end + 1:04d}-01-01 00:00:00").cast(kind)))
    return found.orderBy(F.desc("first_submitted_at"), "arxiv_id").limit(limit).withColumn("matched_by", F.year("first_submitted_at").cast("string"))


def _list(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """(arxiv_id, name): an ordered list for each paper."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy("arxiv_id").agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def paper_detail(graph: Graph, arxiv_id=None) -> DataFrame:
    """Papers with their authors, categories and versions as ordered lists and one
    journal reference, if any.  A paper without any author, category or version has
    no row, as a required pattern would have it."""
    only = (lambda df: df) if arxiv_id is None else (lambda df: df.filter(F.col("arxiv_id") == arxiv_id))
    authors = _list(only(graph.authored).join(graph.authors.select("author_id", "display_name"), "author_id"), "position", F.col("display_name"), "authors")
    categories = _list(only(graph.in_category), "position", F.col("code"), "categories")
    versions = _list(only(graph.versions), "version_number", F.struct("label", "created_at"), "versions")
    journal = only(graph.published_in).groupBy("arxiv_id").agg(F.min("journal_reference_raw").alias("journal"))
    return only(graph.papers).join(authors, "arxiv_id").join(categories, "arxiv_id").join(versions, "arxiv_id").join(journal, "arxiv_id", "left")


def vector_search(graph: Graph, query: Sequence[float], top_k: int = 5, name: str = "embedding", index: VI.VectorIndex | None = None, probes: int | None = None) -> DataFrame:
    """(arxiv_id, score) of the nearest papers, by cosine on a scale from 0 to 1.

    Exact: one pass over the vectors, of which each task keeps its own best.  With a
    stored ``index`` the cells that could hold one of the best are read, or the nearest
    ``probes`` of them, which may miss some.
    """
    _limit("top_k", top_k, 50)
    if index is not None:
        return VI.search(index, [float(x) for x in query], top_k, probes or VI.PROBES, exact=probes is None).withColumnRenamed("key", "arxiv_id")
    query = [float(x) for x in query]
    own = V.literal(query)
    right = graph.embeddings.filter((F.col("property") == name) & F.col("vector").isNotNull())
    wrong = F.raise_error(F.lit(f"INVALID_EMBEDDING_DIMENSION: {len(query)}")).cast("double")
    score = F.when(F.size("vector") == len(query), V.cosine_score("vector", own)).otherwise(wrong)
    return right.select("arxiv_id", score.alias("score")).orderBy(F.desc("score"), "arxiv_id").limit(top_k)


def text_vector_search(graph: Graph, encoder: V.Encoder, query: str, top_k: int = 5) -> DataFrame:
    """``vector_search`` of an encoded text."""
    try:
        vector = V.encode_query(encoder, query)
    except ValueError as e:
        raise GraphError("EMPTY_QUERY", str(e)) from None
    return vector_search(graph, vector, top_k)


def papers_with(graph: Graph, papers: DataFrame, year: tuple[int, int] | None = None, category: str | None = None, author: str | None = None, entity: tuple[str, str] | None = None) -> DataFrame:
    """An extension: ``papers`` that meet all the filters given, as semi-joins."""
    if year:
        papers = papers.join(graph.papers.filter((F.col("first_submitted_at") >= F.lit(f"{year[0]:04d}-01-01").cast("timestamp_ntz")) & (F.col("first_submitted_at") < F.lit(f"{year[1] + 1:04d}-01-01").cast("timestamp_ntz"))).select("arxiv_id"), "arxiv_id", "left_semi")
    if category:
        papers = papers.join(graph.in_category.filter(F.col("code") == category).select("arxiv_id"), "arxiv_id", "left_semi")
    if author is not None:
        names = graph.authors.filter(F.contains("normalized_name", F.lit(normalize_name(author)))).select("author_id")
        papers = papers.join(graph.authored.join(names, "author_id", "left_semi").select("arxiv_id"), "arxiv_id", "left_semi")
    if entity:
        papers = papers.join(graph.mentions.filter((F.col("entity_type") == entity[0]) & (F.col("normalized_name") == entity[1])).select("arxiv_id"), "arxiv_id", "left_semi")
    return papers


def hybrid(lexical: DataFrame, semantic: DataFrame, weight: float = 0.5, limit: int = 10, flat: float = 1.0) -> DataFrame:
    """An extension: two result lists (arxiv_id, score) as one, by the weighted sum of
    their scores, each scaled to 0..1 in its list; ``methods`` says where a paper
    was found.  In a list whose scores are all equal each is ``flat``."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        return df.join(F.broadcast(ends)).select("arxiv_id", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(flat)).alias(name))

    both = scaled(lexical, "lexical").join(scaled(semantic, "semantic"), "arxiv_id", "full_outer")
    score = weight * F.coalesce("lexical", F.lit(0.0)) + (1 - weight) * F.coalesce("semantic", F.lit(0.0))
    methods = F.array_compact(F.array(F.when(F.col("lexical").isNotNull(), "lexical"), F.when(F.col("semantic").isNotNull(), "semantic")))
    return both.select("arxiv_id", score.alias("score"), methods.alias("methods")).orderBy(F.desc("score"), "arxiv_id").limit(limit)
