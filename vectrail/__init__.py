"""Spark-native analytics for embedding and text collections."""

__version__ = "0.1.0"
