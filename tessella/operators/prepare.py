"""Binarising, metadata, label coding and splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import binarise, half_added, is_active

# Codes of cell types, short and long list.
SHORT_CODES = {"Ast": 1, "End": 2, "Ex": 3, "In": 4, "Mic": 5, "Oli": 6, "Opc": 7, "Per": 8}
LONG_CODES = {
    "Astrocyte": 1,
    "Endothelial": 2,
    "Excitatory Neurons": 3,
    "Inhibitory Neurons": 4,
    "Microglia": 5,
    "Oligodendrocytes": 6,
    "OPCs": 7,
    "Pericytes": 8,
    "Fibroblast": 9,
    "NFOL/MOL": 10,
    "Macrophages": 11,
    "Monocytes": 12,
    "SMC": 13,
    "COP": 14,
    "NK Cells": 15,
    "Neutrophils": 16,
    "CD8+ T Cells": 17,
    "Erythrocytes": 18,
}


def binarise_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("x", binarise("x"))


def binarise_entries(entries: DataFrame) -> DataFrame:
    """Of the coordinate layout only active entries stay, as ones; the filter reaches the scan."""
    return entries.filter(is_active(F.col("value"))).withColumn("value", F.lit(1.0))


def normal_key(key: Column | str) -> Column:
    """Keys with dots in place of dashes get their dashes back."""
    return F.replace(F.col(key) if isinstance(key, str) else key, F.lit("."), F.lit("-"))


def attach(cells: DataFrame, metadata: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Metadata columns by key; a cell without metadata has nulls. Keys in metadata must be unique: see repeated_keys."""
    return cells.join(metadata.select(key, *columns), key, "left")


def repeated_keys(metadata: DataFrame, key: str) -> DataFrame:
    return metadata.groupBy(key).count().filter("count > 1")


def key_overlap(cells: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Number of keys that both have."""
    return cells.select(key).intersect(metadata.select(key)).agg(F.count("*").alias("shared"))


def annotation_gap(cells: DataFrame, column: str) -> DataFrame:
    """Rows, rows with and rows without a value."""
    return cells.agg(F.count("*").alias("cells"), F.count(column).alias("annotated"), F.count_if(F.col(column).isNull()).alias("missing"))


def annotated(cells: DataFrame, column: str) -> DataFrame:
    return cells.filter(F.col(column).isNotNull())


def encode_labels(rows: DataFrame, column: str, codes: Mapping[str, int], out: str = "label") -> DataFrame:
    """The code of each name; a name without a code is null. The codes are a literal map: a few names, whatever the data."""
    table = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    return rows.withColumn(out, F.element_at(table, F.col(column)).cast("int"))


def name_labels(rows: DataFrame, codes: Mapping[str, int], column: str = "label", out: str = "name") -> DataFrame:
    """The inverse of encode_labels; a code without a name is null."""
    table = F.create_map(*(F.lit(x) for name, code in codes.items() for x in (code, name)))
    return rows.withColumn(out, F.element_at(table, F.col(column).cast("int")))


def coded_only(rows: DataFrame, column: str = "label") -> DataFrame:
    return rows.dropna(subset=[column]).withColumn(column, F.col(column).cast("int"))


def recode_others(rows: DataFrame, known: Iterable[int], other: int, column: str = "label") -> DataFrame:
    return rows.withColumn(column, F.when(~F.col(column).isin(*known), other).otherwise(F.col(column)))


def labelled(rows: DataFrame, column: str = "label", unlabelled: int = 0) -> DataFrame:
    return rows.filter(F.col(column) != unlabelled)


def of_classes(rows: DataFrame, classes: Iterable[int], column: str = "label") -> DataFrame:
    return rows.filter(F.col(column).isin(*classes))


def split_at(rows: DataFrame, border: int, key: str = "cell_id") -> DataFrame:
    """Rows marked train below the border key, else test."""
    return rows.withColumn("part", F.when(F.col(key) < border, "train").otherwise("test"))


def composed(cells: DataFrame, recalled: DataFrame) -> DataFrame:
    """Each cell plus half of its recall."""
    return cells.join(recalled.select("cell_id", F.col("x").alias("recall")), "cell_id").withColumn("x", half_added("x", "recall")).drop("recall")


def keyed_together(cells: DataFrame, *others: DataFrame) -> DataFrame:
    """cells joined to other tables by cell_id; an error if any of them lacks or adds a cell.

    It takes the place of files that belong together line by line. The check is one aggregation over full joins of keys.
    """
    for other in others:
        keys = cells.select("cell_id", F.lit(1).alias("a")).join(other.select("cell_id", F.lit(1).alias("b")), "cell_id", "full")
        odd = keys.agg(F.count_if(F.col("b").isNull()).alias("lacks"), F.count_if(F.col("a").isNull()).alias("adds")).first()
        if odd["lacks"] or odd["adds"]:
            raise ValueError(f"{odd['lacks']} cells are missing, {odd['adds']} are unknown")
        cells = cells.join(other, "cell_id")
    return cells
