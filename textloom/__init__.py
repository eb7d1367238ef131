"""Spark-first engine for preparing, querying and evaluating language-model data."""

__version__ = "0.1.0"
