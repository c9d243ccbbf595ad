"""Spark-native engine for long-lived text memory: search, facts, governance, evaluation."""

__version__ = "0.1.0"
