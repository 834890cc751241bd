"""Spark-native engine for document/code index analytics and training-data preparation."""

__version__ = "0.1.0"
