"""Spark-first document-analytics engine: DataFrame operators, sources, report plans and streams."""

__version__ = "0.1.0"
