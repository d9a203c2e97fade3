"""Corpus counts and data-quality checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENTITY_TYPES, TABLES, Graph


def corpus_stats(graph: Graph) -> DataFrame:
    """One row: papers, authors, categories, entities by type, papers with entities."""
    one = lambda df, *columns: df.agg(*columns)
    counts = [
        one(graph.papers, F.count(F.lit(1)).alias("paper_count")),
        one(graph.authors, F.count(F.lit(1)).alias("author_count")),
        one(graph.categories, F.count(F.lit(1)).alias("category_count")),
        one(graph.entities, *(F.count_if(F.col("entity_type") == t).alias(f"{t}_count") for t in ENTITY_TYPES)),
        one(graph.papers.select("arxiv_id").join(graph.mentions.select("arxiv_id"), "arxiv_id", "left_semi"), F.count(F.lit(1)).alias("papers_with_entities")),
    ]
    out = counts[0]
    for more in counts[1:]:  # products of single rows
        out = out.crossJoin(more)
    return out


#: Checks as SQL over the graph's tables; each returns ``violations``.
CHECKS = """
-- check: papers_without_authors
-- description: every paper has an author
SELECT count(*) AS violations FROM papers p LEFT ANTI JOIN authored a ON p.arxiv_id = a.arxiv_id

-- check: papers_without_categories
-- description: every paper is in a category
SELECT count(*) AS violations FROM papers p LEFT ANTI JOIN in_category c ON p.arxiv_id = c.arxiv_id

-- check: papers_missing_title_or_abstract
-- description: every paper has a title and an abstract
SELECT count(*) AS violations FROM papers WHERE title IS NULL OR abstract IS NULL

-- check: duplicate_author_positions
-- description: a paper has no two authors at one position
SELECT count(*) AS violations FROM (SELECT 1 FROM authored GROUP BY arxiv_id, position HAVING count(*) > 1)

-- check: non_positive_version_numbers
-- description: version numbers are above 0
SELECT count(*) AS violations FROM versions WHERE version_number <= 0

-- check: papers_with_multiple_submitters
-- description: a paper has one submitter at most
SELECT count(*) AS violations FROM (SELECT 1 FROM submitted GROUP BY arxiv_id HAVING count(*) > 1)
"""


def parse_checks(text: str) -> list[tuple[str, str, str]]:
    """(name, description, query) of blocks between blank lines."""
    found = []
    for block in re.split(r"\n\s*\n", text.strip()):
        name = re.search(r"^--\s*check:\s*(.+)$", block, re.M)
        about = re.search(r"^--\s*description:\s*(.+)$", block, re.M)
        query = "\n".join(line for line in block.splitlines() if not line.lstrip().startswith("--")).strip().rstrip(";")
        if not query:
            continue
        if not name:
            raise ValueError(f"a check has no name: {query[:60]}")
        found.append((name[1].strip(), about[1].strip() if about else "", query))
    return found


def validate(graph: Graph, text: str = CHECKS) -> DataFrame:
    """(name, description, violations, passed) of each check."""
    tables = graph.tables()
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, about, query in parse_checks(text):
        used = {t: df for t, df in tables.items() if re.search(rf"\b{t}\b", query)}
        bound = re.sub("|".join(rf"(?<=FROM ){t}\b|(?<=JOIN ){t}\b" for t in used), lambda m: "{" + m[0] + "}", query) if used else query
        row = spark.sql(bound, **used).select(F.lit(name).alias("name"), F.lit(about).alias("description"), F.col("violations").cast("long").alias("violations"), (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def report(rows) -> tuple[list[str], bool]:
    """Lines for a console, and whether all checks passed."""
    lines = []
    for r in rows:
        lines.append(f"{'PASS' if r['passed'] else 'FAIL'} {r['name']}: {r['violations']}")
        if not r["passed"]:
            lines.append(f"     {r['description']}")
    return lines, all(r["passed"] for r in rows)


def unique_keys(graph: Graph) -> DataFrame:
    """(table, repeated): how many keys of each table occur more than once."""
    out = None
    for name, df in graph.tables().items():
        row = df.groupBy(*TABLES[name][0]).count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated")).select(F.lit(name).alias("table"), "repeated")
        out = row if out is None else out.unionByName(row)
    return out


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The graph's tables in the catalogue, if they aren't there; may be repeated."""
    for name, (_, ddl) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet")


def run_script(spark: SparkSession, text: str) -> int:
    """Runs the statements between semicolons; how many there were."""
    statements = [s.strip() for s in text.split(";") if s.strip()]
    for statement in statements:
        spark.sql(statement)
    return len(statements)
