"""Reversible, Spark-native data preparation."""

__version__ = "0.1.0"
