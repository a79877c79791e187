"""Operators: DataFrames in, DataFrames out, rows always told apart by keys."""
