"""Expansion of seed papers to related ones, with explained ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..schema import Graph, GraphError

AUTHOR_WEIGHT, CATEGORY_WEIGHT = 0.1, 0.05


def seed_context(graph: Graph, seeds: Sequence) -> DataFrame:
    """(arxiv_id, authors, categories, journal) of known seeds; lists are sorted and
    distinct, by display name; a paper of several journals has the first by name."""
    own = lambda df: df.filter(F.col("arxiv_id").isin(list(seeds)))
    names = own(graph.authored).join(graph.authors.select("author_id", "display_name"), "author_id").groupBy("arxiv_id").agg(F.array_sort(F.collect_set("display_name")).alias("authors"))
    codes = own(graph.in_category).groupBy("arxiv_id").agg(F.array_sort(F.collect_set("code")).alias("categories"))
    journal = own(graph.published_in).join(graph.journals.select("journal_id", "name"), "journal_id").groupBy("arxiv_id").agg(F.min("name").alias("journal"))
    none = F.array().cast("array<string>")
    found = own(graph.papers).select("arxiv_id").join(names, "arxiv_id", "left").join(codes, "arxiv_id", "left").join(journal, "arxiv_id", "left")
    return found.select("arxiv_id", F.coalesce("authors", none).alias("authors"), F.coalesce("categories", none).alias("categories"), "journal")


def _pool(edges: DataFrame, name: str, size: int | None) -> DataFrame:
    """(arxiv_id, shared) of the papers with most shared values, ties by id."""
    pool = edges.groupBy("arxiv_id").agg(F.array_sort(F.collect_set(name)).alias("shared"))
    return pool if size is None else pool.orderBy(F.desc(F.size("shared")), "arxiv_id").limit(size)


def related_by_author(graph: Graph, seeds: Sequence, pool_size: int | None = 20) -> DataFrame:
    """(arxiv_id, shared): papers that share an author with a seed, and the names."""
    seeds = list(seeds)
    shared = graph.authored.filter(F.col("arxiv_id").isin(seeds)).select("author_id").distinct().join(graph.authors.select("author_id", "display_name"), "author_id")
    # the seeds' authors are few; the edges aren't moved if they fit a broadcast
    edges = graph.authored.filter(~F.col("arxiv_id").isin(seeds)).select("author_id", "arxiv_id").join(shared, "author_id")
    return _pool(edges, "display_name", pool_size)


def related_by_category(graph: Graph, seeds: Sequence, pool_size: int | None = 20) -> DataFrame:
    """(arxiv_id, shared): papers whose primary category is a seed's, and the code.
    A paper has one primary category, so all tie and the least ids are chosen."""
    seeds = list(seeds)
    primary = graph.in_category.filter("primary").select("arxiv_id", "code")
    shared = primary.filter(F.col("arxiv_id").isin(seeds)).select("code").distinct()
    return _pool(primary.filter(~F.col("arxiv_id").isin(seeds)).join(shared, "code", "left_semi"), "code", pool_size)


def related_by_entity(graph: Graph, seeds: Sequence, entity_type: str, pool_size: int | None = 20) -> DataFrame:
    """An extension: papers that mention an entity that a seed mentions."""
    seeds = list(seeds)
    own = graph.mentions.filter(F.col("entity_type") == entity_type).select("arxiv_id", "normalized_name")
    shared = own.filter(F.col("arxiv_id").isin(seeds)).select("normalized_name").distinct()
    return _pool(own.filter(~F.col("arxiv_id").isin(seeds)).join(shared, "normalized_name", "left_semi"), "normalized_name", pool_size)


def hops(graph: Graph, seeds: Sequence, depth: int = 2) -> DataFrame:
    """An extension: (arxiv_id, hop) of all papers within ``depth`` shared authors of the
    seeds."""
    seen = graph.papers.filter(F.col("arxiv_id").isin(list(seeds))).select("arxiv_id", F.lit(0).alias("hop"))
    edges = graph.authored.select("author_id", "arxiv_id").distinct()
    for hop in range(1, depth + 1):
        front = seen.filter(F.col("hop") == hop - 1).select("arxiv_id")
        authors = edges.join(front, "arxiv_id", "left_semi").select("author_id").distinct()
        more = edges.join(authors, "author_id", "left_semi").select("arxiv_id").distinct().join(seen, "arxiv_id", "left_anti")
        seen = seen.unionByName(more.select("arxiv_id", F.lit(hop).alias("hop")))
    return seen


def expand(graph: Graph, seeds: Sequence, query: Sequence[float] | None = None, related_limit: int = 5, pool_size: int = 20, name: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The seeds' context, and (arxiv_id, title, shared_authors, shared_categories,
    score, rank) of related papers.

    Each pool is cut before they are merged.  Without a query, papers rank by shared
    authors and then categories; with one, by similarity plus a weight for each.
    Ties keep the order of the author pool and then that of the category pool.
    """
    if not list(seeds):
        raise GraphError("EMPTY_PAPER_IDS", "no seed papers")
    related_limit, pool_size = min(related_limit, 50), min(pool_size, 200)
    place = lambda df, at: df.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.size("shared")), "arxiv_id")) + at)
    authors, categories = place(related_by_author(graph, seeds, pool_size), 0), place(related_by_category(graph, seeds, pool_size), pool_size)
    none = F.array().cast("array<string>")
    pool = authors.select("arxiv_id", F.col("shared").alias("shared_authors"), F.col("place").alias("first")).join(categories.select("arxiv_id", F.col("shared").alias("shared_categories"), F.col("place").alias("second")), "arxiv_id", "full_outer")
    pool = pool.select("arxiv_id", F.coalesce("shared_authors", none).alias("shared_authors"), F.coalesce("shared_categories", none).alias("shared_categories"), F.coalesce("first", "second").alias("place"))
    # at most two pools' rows
    found = graph.papers.select("arxiv_id", "title").join(F.broadcast(pool), "arxiv_id")
    n_authors, n_categories = F.size("shared_authors"), F.size("shared_categories")
    if query is None:
        order = [F.desc(n_authors), F.desc(n_categories), "place"]
        found = found.withColumn("score", F.lit(None).cast("double"))
    else:
        own = graph.embeddings.filter(F.col("property") == name).select("arxiv_id", "vector").join(F.broadcast(pool.select("arxiv_id")), "arxiv_id", "left_semi")
        similarity = F.coalesce(V.dot("vector", V.literal(query)), F.lit(0.0))
        found = found.join(own, "arxiv_id", "left").withColumn("score", similarity + AUTHOR_WEIGHT * n_authors + CATEGORY_WEIGHT * n_categories).drop("vector")
        order = [F.desc("score"), "place"]
    top = found.orderBy(*order).limit(related_limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return seed_context(graph, seeds), ranked.select("arxiv_id", "title", "shared_authors", "shared_categories", "score", "rank")


def search_and_expand(graph: Graph, query: Sequence[float], top_k: int = 5, index=None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nearest papers, by a stored vector ``index`` if there is one, and the
    expansion of them with the same query."""
    from .search import vector_search

    hits = vector_search(graph, query, top_k, index=index)
    seeds = [r.arxiv_id for r in hits.select("arxiv_id").collect()]  # top_k ids
    return (hits, *expand(graph, seeds, query, **options))


def expand_paper(graph: Graph, arxiv_id, **options) -> tuple[DataFrame, DataFrame]:
    """The expansion of one paper with its own embedding, if it has one."""
    from .search import paper_by_id

    row = paper_by_id(graph, arxiv_id).first()
    if row is None:
        raise GraphError("PAPER_NOT_FOUND", str(arxiv_id))
    return expand(graph, [arxiv_id], row["embedding"], **options)
