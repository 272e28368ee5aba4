"""Spark-native site-audit and corpus analytics."""

__version__ = "0.1.0"
