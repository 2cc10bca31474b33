"""Spark-native engine for scholarly text and metadata."""

__version__ = "0.1.0"
