"""Two data sets onto one dictionary of features: dictionaries, overlap, alignment, fill, tracking, checks, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What stands for a feature that a data set lacks.
ABSENT = 0.5


def first_names(dictionary: DataFrame) -> DataFrame:
    """feature_name and feature_id, one row for each name: that of the first line. One aggregation, no sort."""
    return dictionary.groupBy("feature_name").agg(F.min_by("feature_id", "line_no").alias("feature_id"), F.min("line_no").alias("line_no"))


def last_names(dictionary: DataFrame) -> DataFrame:
    """The name of each id: that of its last line."""
    return dictionary.groupBy("feature_id").agg(F.max_by("feature_name", "line_no").alias("feature_name"))


def resolved(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Features (feature_name, pos) with their id; a name that the dictionary lacks is its own id."""
    return features.join(dictionary.select("feature_name", "feature_id"), "feature_name", "left").withColumn("feature_id", F.coalesce("feature_id", "feature_name"))


def canonical_order(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """feature_id and pos: distinct ids in the order of their first appearance. A dictionary's worth of rows is ordered."""
    ids = resolved(features, dictionary).groupBy("feature_id").agg(F.min("pos").alias("source_pos"))
    return ids.select("feature_id", (F.row_number().over(W.orderBy("source_pos", "feature_id")) - 1).alias("pos"))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """Numbers of ids that both dictionaries have, only the first, only the second."""
    a, b = first.select("feature_id").distinct().withColumn("a", F.lit(1)), second.select("feature_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "feature_id", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))


def common_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("feature_id").intersect(second.select("feature_id"))


def ids_only_in(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("feature_id").subtract(second.select("feature_id"))


def align(entries: DataFrame, features: DataFrame, dictionary: DataFrame, order: DataFrame) -> DataFrame:
    """Entries (cell_id, pos, value) at the canonical positions. Features without one vanish; entries that meet are summed.

    The map of positions has a row for each feature of the source; Spark broadcasts it if it is below its threshold. The sum
    is partial before the shuffle, which is the only one.
    """
    moves = resolved(features, dictionary).join(order.withColumnRenamed("pos", "target"), "feature_id").select("pos", "target")
    return entries.join(moves, "pos").groupBy("cell_id", F.col("target").alias("pos")).agg(F.sum("value").alias("value"))


def absent(features: DataFrame, dictionary: DataFrame, order: DataFrame) -> DataFrame:
    """Canonical positions for which the source has no feature."""
    return order.join(resolved(features, dictionary), "feature_id", "left_anti")


def filled(entries: DataFrame, cells: DataFrame, absent_positions: DataFrame, value: float = ABSENT) -> DataFrame:
    """Entries with the fill value at each absent position of each cell: a view for exports.

    Nothing else needs it: an absent feature adds nothing to any score. The positions are a dictionary's worth of rows, so each
    cell gets them as one array, not by a cross join.
    """
    positions = absent_positions.agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    held = cells.select("cell_id").join(F.broadcast(positions))  # one row
    return entries.unionByName(held.select("cell_id", F.explode("positions").alias("pos"), F.lit(float(value)).alias("value")))


def tracking(first: DataFrame, second: DataFrame, order: DataFrame) -> DataFrame:
    """Features of the first dictionary that the second lacks, with their place and the value filled in."""
    lacking = order.join(ids_only_in(first, second), "feature_id").join(last_names(first), "feature_id", "left")
    return lacking.select(F.coalesce("feature_name", "feature_id").alias("feature_name"), "feature_id", "pos", F.lit(ABSENT).alias("filled"), F.lit(True).alias("in_first"), F.lit(False).alias("in_second"))


def coverage(top: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Features of a top list (feature_name, ...) with their id in the first dictionary and whether the second has that id."""
    there = second.select("feature_id").distinct().withColumn("there", F.lit(True))
    found = top.join(first_names(first).select("feature_name", "feature_id"), "feature_name", "left").join(there, "feature_id", "left")
    return found.select(*top.columns, "feature_id", F.coalesce("there", F.lit(False)).alias("in_second"), F.col("feature_id").isNull().alias("without_id"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Counts of a coverage table, and the share that is present in percent (null if there are no features)."""
    counts = covered.agg(F.count("*").alias("features"), F.count_if("in_second").alias("present"), F.count_if("without_id").alias("without_id"))
    return counts.withColumn("absent", F.expr("features - present - without_id")).withColumn("present_percent", F.try_divide(100.0 * F.col("present"), F.col("features")))


def divergences(first: DataFrame, second: DataFrame, most: int = 5) -> DataFrame:
    """The first places at which two orders of features differ, a missing place included."""
    both = first.select("pos", F.col("feature_id").alias("first_id")).join(second.select("pos", F.col("feature_id").alias("second_id")), "pos", "full")
    return both.filter(~F.col("first_id").eqNullSafe(F.col("second_id"))).orderBy("pos").limit(most)


def require_same_order(first: DataFrame, second: DataFrame) -> None:
    found = divergences(first, second).collect()
    if found:
        raise ValueError("features differ: " + "; ".join(f"{r['pos']}: {r['first_id']} / {r['second_id']}" for r in found))
