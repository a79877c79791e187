"""Tessella: a Spark-native engine for binary feature matrices and associative recall."""

__version__ = "0.1.0"
