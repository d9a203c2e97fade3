"""The property graph as tables: one for each node label and edge type."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

RAW = """id string, submitter string, authors string, title string, comments string,
`journal-ref` string, doi string, `report-no` string, categories string, license string,
abstract string, versions array<struct<version: string, created: string>>, update_date string,
authors_parsed array<array<string>>"""

#: Key and columns of each table; fixed values, as readers know them by these names.
TABLES: dict[str, tuple[list[str], str]] = {
    "papers": (["arxiv_id"], "arxiv_id string, title string, abstract string, comments string, doi string, license string, update_date date, first_submitted_at timestamp, latest_version string, version_count int, source string"),
    "authors": (["author_id"], "author_id string, display_name string, family_name string, given_names string, suffix string, normalized_name string"),
    "submitters": (["submitter_id"], "submitter_id string, name string, normalized_name string"),
    "versions": (["version_id"], "version_id string, arxiv_id string, version_number int, label string, created_at timestamp"),
    "categories": (["code"], "code string"),
    "journals": (["journal_id"], "journal_id string, name string, normalized_name string"),
    "reports": (["report_number"], "report_number string"),
    "authored": (["author_id", "arxiv_id"], "author_id string, arxiv_id string, position int"),
    "in_category": (["arxiv_id", "code"], "arxiv_id string, code string, position int, primary boolean"),
    "submitted": (["submitter_id", "arxiv_id"], "submitter_id string, arxiv_id string, submitted_at timestamp, source string"),
    "published_in": (["arxiv_id", "journal_id"], "arxiv_id string, journal_id string, journal_reference_raw string, doi string"),
    "has_report": (["arxiv_id", "report_number"], "arxiv_id string, report_number string"),
    "entities": (["entity_type", "normalized_name"], "entity_type string, normalized_name string, name string"),
    "mentions": (["arxiv_id", "entity_type", "normalized_name"], "arxiv_id string, entity_type string, normalized_name string, confidence double, extraction_model string, extracted_at timestamp, raw_name string"),
    "embeddings": (["arxiv_id", "property"], "arxiv_id string, property string, vector array<float>, model string"),
}

#: Entity types and the edge type of each.
ENTITY_TYPES = {"method": "USES_METHOD", "dataset": "USES_DATASET", "topic": "STUDIES_TOPIC"}


@dataclass
class Graph:
    """The tables of a graph; those that a reader doesn't need may be None."""

    papers: DataFrame | None = None
    authors: DataFrame | None = None
    submitters: DataFrame | None = None
    versions: DataFrame | None = None
    categories: DataFrame | None = None
    journals: DataFrame | None = None
    reports: DataFrame | None = None
    authored: DataFrame | None = None
    in_category: DataFrame | None = None
    submitted: DataFrame | None = None
    published_in: DataFrame | None = None
    has_report: DataFrame | None = None
    entities: DataFrame | None = None
    mentions: DataFrame | None = None
    embeddings: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        """The tables that there are, by name."""
        return {f.name: t for f in fields(self) if (t := getattr(self, f.name)) is not None}


def empty(spark: SparkSession) -> Graph:
    """A graph without rows."""
    return Graph(**{name: spark.createDataFrame([], ddl) for name, (_, ddl) in TABLES.items()})


class GraphError(ValueError):
    """An argument that a query rejects; ``code`` is its stable name."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
