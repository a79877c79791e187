"""Recall of cells that keep arriving."""
