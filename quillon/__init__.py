"""Spark-native scoped retrieval, prompt rendering and context compaction."""

__version__ = "0.1.0"
