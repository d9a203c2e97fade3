"""The engine's Spark session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def spark_session(app: str = "quirelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results depend on (UTC, ANSI
    casts) and adaptive execution; partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**fixed, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
