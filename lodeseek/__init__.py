"""Spark-native evidence retrieval engine: every operator is a DataFrame transformation."""

__version__ = "0.1.0"
