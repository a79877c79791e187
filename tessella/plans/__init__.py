"""Queries on the driver's tables, each with its counterpart in DuckDB SQL."""
