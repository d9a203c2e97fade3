"""The driver's test tables as a graph, so that the operators themselves run on them.

Papers are orders, authors are parts, lines of an order are its authors by
position, the priority is the primary category, the customer's market segment is
the journal, events are mentions and vectors are those of the papers of their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as resolved mentions, in order of time and then id."""
    kind = F.when(F.col("event_type").isin("click", "view"), "method").when(F.col("event_type").isin("error", "signup"), "dataset").otherwise("topic")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("arxiv_id"), kind.alias("entity_type"), F.col("event_type").alias("normalized_name"), F.initcap("event_type").alias("name"), F.col("value").alias("confidence"), F.lit(None).cast("string").alias("extraction_model"), F.col("ts").alias("extracted_at"), F.col("event_type").alias("raw_name"), F.struct("ts", "event_id").alias("seq"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph over the tables below ``sf_dir``; nothing is read yet."""
    t = lambda name: table(spark, sf_dir, name)
    orders, part = t("orders"), t("part")
    date = F.col("o_orderdate")
    papers = orders.select(F.col("o_orderkey").alias("arxiv_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("abstract"), date.alias("update_date"), date.alias("first_submitted_at"))
    journal = F.col("c_mktsegment")
    published = orders.join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("arxiv_id"), journal.alias("journal_id"), journal.alias("journal_reference_raw"))
    last = F.max_by(F.col("confidence"), "seq")
    rows = mention_rows(spark, sf_dir)
    return Graph(
        papers=papers,
        authors=part.select(F.col("p_partkey").alias("author_id"), F.col("p_name").alias("display_name"), F.lower("p_name").alias("normalized_name")),
        authored=t("lineitem").select(F.col("l_partkey").alias("author_id"), F.col("l_orderkey").alias("arxiv_id"), F.col("l_linenumber").alias("position")),
        in_category=orders.select(F.col("o_orderkey").alias("arxiv_id"), F.col("o_orderpriority").alias("code"), F.lit(1).alias("position"), F.lit(True).alias("primary")),
        categories=orders.select(F.col("o_orderpriority").alias("code")).distinct(),
        versions=orders.select(F.col("o_orderkey").alias("arxiv_id"), F.lit(1).alias("version_number"), F.concat(F.lit("v"), F.col("o_orderstatus")).alias("label"), date.alias("created_at")),
        submitted=orders.select(F.col("o_custkey").alias("submitter_id"), F.col("o_orderkey").alias("arxiv_id")),
        published_in=published,
        journals=t("customer").select(F.col("c_mktsegment").alias("journal_id"), F.col("c_mktsegment").alias("name")).distinct(),
        entities=rows.select("entity_type", "normalized_name", "name").distinct(),
        mentions=rows.groupBy("arxiv_id", "entity_type", "normalized_name").agg(last.alias("confidence")),
        embeddings=t("embeddings").select(F.col("vec_id").alias("arxiv_id"), F.lit("embedding").alias("property"), F.col("embedding").alias("vector"), F.lit("test").alias("model")),
    )
