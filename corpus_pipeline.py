"""A corpus pipeline: five stages, each of which works on all that the one before
kept.  Every stage's result is written and read again, so a lost executor costs a
part of one stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import language_id, line_dedup, ngram_join, packing, secret_scan
from quirelake.llm.common import table, written

#: Duplicates whose ids are broadcast (8 bytes each).
BROADCAST_DUPLICATES = 1 << 20


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df``, n_chars by its text as it is now."""
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, of one language or several; those without go.  A null
    lang becomes the predicted one, unless the letters are of no learned script."""
    model = language_id.fit(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    # without any labelled row every text is und, so letters are looked for too
    kept = language_id.identify(docs, model).filter((F.col("lang_pred") != language_id.UNDETERMINED) | F.col("text").rlike(r"\p{L}"))
    known = F.when(F.col("score") > 0, F.col("lang_pred"))
    return kept.select(*(F.coalesce("lang", known).alias(c) if c == "lang" else c for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return _with_text(line_dedup.drop_repeated_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    gone = written(ngram_join.jaccard_components(docs).filter("component_id < doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_DUPLICATES else gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live-looking credentials masked."""
    return _with_text(secret_scan.redact(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL can't express the stages; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace(".", ""))
    return docs
