"""Frequencies, top features, column selection, counts of values, shuffles and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import pick


def feature_frequency(entries: DataFrame, features: DataFrame) -> DataFrame:
    """Each feature's sum over all cells; features without entries have 0. Partial sums come before the shuffle."""
    sums = entries.groupBy("pos").agg(F.sum("value").alias("frequency"))
    return features.join(sums, "pos", "left").fillna(0.0, ["frequency"])


def top_features(frequency: DataFrame, n: int) -> DataFrame:
    """The n most frequent features (or all there are) with rank from 1; ties by position. Each task keeps n rows."""
    best = frequency.orderBy(F.desc("frequency"), "pos").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("frequency"), "pos")))


def keep_features(entries: DataFrame, top: DataFrame, by: str = "pos") -> DataFrame:
    """Entries of the selected features, at new places: in file order (by = pos) or in the order of frequency (by = rank)."""
    places = top.select("pos", (F.row_number().over(W.orderBy(by)) - 1).alias("place"))
    return entries.join(places, "pos").select("cell_id", F.col("place").alias("pos"), "value")


def keep_columns(cells: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Vectors of the components at the positions, in their order."""
    return cells.withColumn("x", pick("x", positions))


def value_counts(rows: DataFrame, column: str, by_count: bool = True) -> DataFrame:
    """How often each value occurs: most frequent first, ties by value; or by value."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column) if by_count else counts.orderBy(column)


def shuffled(rows: DataFrame, seed: int, key: str = "cell_id") -> DataFrame:
    """Rows in an order drawn from a hash of the key: the same whatever the partitions."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)).cast("binary")), key)


def sample_of(rows: DataFrame, n: int, seed: int, key: str = "cell_id") -> DataFrame:
    """n rows (or all there are) of that order; each task keeps n rows."""
    return shuffled(rows, seed, key).limit(n)
