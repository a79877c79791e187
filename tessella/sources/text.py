"""Text in and out. Rows of a text file are known by their line; every reader attaches that number as a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matlab import read_mat


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, over files in the order of their names) and value of each line, in one pass and without a shuffle of lines.

    Spark deals the blocks of a file out in any order, but keeps lines in order within one: a line's number is the number of
    lines in earlier blocks plus its place in its own. The table of blocks has a row for each split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.withColumn("before", before).drop("n"), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("least")).alias("line_no"), "value")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """line_no, feature_id and feature_name from tab-separated text without a header; gzip by extension; further columns are ignored."""
    parts = F.split("value", "\t")
    return numbered_lines(spark, path).select("line_no", F.get(parts, F.lit(0)).alias("feature_id"), F.get(parts, F.lit(1)).alias("feature_name"))


def read_header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """The names in the first line of a text file; no more than one line is read."""
    return spark.read.text(path).filter("_metadata.file_block_start = 0").first()[0].strip().split(separator)


def read_matrix(spark: SparkSession, path: str, header: bool = False, separator: str = ",") -> DataFrame:
    """cell_id and x from numeric text; a row with other than the first row's number of values, or a value that is no number, is an error."""
    rows = numbered_lines(spark, path)
    if header:
        width = len(read_header(spark, path, separator))
        rows = rows.filter("line_no > 0").withColumn("line_no", F.col("line_no") - 1)
    else:
        width = len(read_header(spark, path, separator))
    x = F.transform(F.split("value", separator), lambda v: F.trim(v).cast("double"))
    checked = F.when(F.size(x) == width, x).otherwise(F.raise_error(F.concat(F.lit("ragged row "), F.col("line_no").cast("string"))))
    return rows.filter(F.length(F.trim("value")) > 0).select(F.col("line_no").alias("cell_id"), checked.alias("x"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """cell_id and label, one integer in each line."""
    return numbered_lines(spark, path).filter(F.length(F.trim("value")) > 0).select(F.col("line_no").alias("cell_id"), F.trim("value").cast("int").alias("label"))


def read_indexed(spark: SparkSession, path: str, schema: str, key: str = "cell_key") -> DataFrame:
    """CSV whose first column, often without a name, is the row's key; ``schema`` is that of the other columns, never inferred.

    A key that is missing or comes twice is an error, as rows are joined by it.
    """
    rows = spark.read.csv(path, header=True, schema=f"`{key}` string, {schema}", mode="FAILFAST")
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).first()
    if twice is not None:
        raise ValueError(f"the key {twice[0]} stands {twice['n']} times in {path}")
    return rows


def read_basis(path: str) -> np.ndarray:
    """A basis from .npy, .mat, else from comma-separated text; it is a model's file, read by the driver."""
    if path.endswith(".mat"):
        return read_mat(path)
    return np.load(path) if path.endswith(".npy") else np.loadtxt(path, delimiter=",", ndmin=2)


def write_matrix(cells: DataFrame, path: str, names: Sequence[str] | None = None, separator: str = ",") -> None:
    """Rows as text in the order of cell_id, without it; the names, if any, in a file of their own that sorts first."""
    spark = cells.sparkSession
    shown = F.transform("x", lambda v: F.when(v == F.floor(v), v.cast("bigint").cast("string")).otherwise(v.cast("string")))
    cells.orderBy("cell_id").select(F.concat_ws(separator, shown)).write.mode("overwrite").text(f"{path}/rows")
    if names is not None:
        spark.createDataFrame([(separator.join(names),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_csv(df: DataFrame, path: str, header: bool = True, index: str | None = None) -> None:
    """CSV; with ``index`` that column comes first and without a name, in its order, as read_indexed takes it."""
    if index is not None:
        others = [c for c in df.columns if c != index]
        df = df.orderBy(index).select(F.col(index).alias(" "), *others)
    df.write.mode("overwrite").option("header", header).csv(path)
