"""A Spark-first analytics engine for scientific-literature knowledge graphs."""

__version__ = "0.1.0"
