"""Scores of a recall: as classification, and as reconstruction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import Patterns, nearest_pattern


def judged(recalled: DataFrame, patterns: DataFrame | Patterns) -> DataFrame:
    """cell_id, label, predicted class, nearest pattern, mismatches with it and width, from recalled cells with labels."""
    found = nearest_pattern(recalled.select("cell_id", "label", "x"), patterns)
    return found.select("cell_id", "label", F.col("cls").alias("predicted"), "pattern_id", "mismatches", F.col("active").alias("active_pattern"), F.aggregate("x", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("active_recall"), F.size("x").alias("width"))


def counted(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, predicted, n, exact, similarity): all that the metrics need; its size is that of a confusion matrix."""
    return rows.groupBy(*by, "label", "predicted").agg(F.count("*").alias("n"), F.count_if(F.col("mismatches") == 0).alias("exact"), F.sum(1 - F.col("mismatches") / F.col("width")).alias("similarity"))


def class_scores(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, cls, precision, recall, f1, support) of the classes in truth or prediction; a division by zero gives 0."""
    truth = counts.groupBy(*by, F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    said = counts.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    hits = counts.filter("label = predicted").groupBy(*by, F.col("label").alias("cls")).agg(F.sum("n").alias("hits"))
    keys = [*by, "cls"]
    all_ = truth.join(said, keys, "full").join(hits, keys, "left").fillna(0, ["support", "said", "hits"])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return all_.select(*keys, zero(F.try_divide(F.col("hits"), F.col("said"))).alias("precision"), zero(F.try_divide(F.col("hits"), F.col("support"))).alias("recall"), zero(F.try_divide(2.0 * F.col("hits"), F.col("said") + F.col("support"))).alias("f1"), "support")


def metrics(rows: DataFrame, classes: Sequence[int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, error, f1_macro, f1_weighted, exact_rate and similarity over cells of the classes evaluated.

    The macro mean runs over the classes in truth or prediction. One shuffle of cells' counts, then tables of classes.
    """
    if classes is not None:
        rows = rows.filter(F.col("label").isin(*classes))
    counts = counted(rows, by)
    whole = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.expr("if(label = predicted, n, 0)")).alias("hits"), F.sum("exact").alias("exact"), F.sum("similarity").alias("similar"))
    f1 = class_scores(counts, by).groupBy(*by).agg(F.avg("f1").alias("f1_macro"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"))
    joined = whole.join(f1, list(by)) if by else whole.crossJoin(f1)  # one row each
    accuracy = F.try_divide(F.col("hits"), F.col("n"))
    return joined.select(*by, "n", accuracy.alias("accuracy"), (1 - accuracy).alias("error"), "f1_macro", "f1_weighted", F.try_divide(F.col("exact"), F.col("n")).alias("exact_rate"), F.try_divide(F.col("similar"), F.col("n")).alias("similarity"))


def confusion(rows: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(label, predicted, n) for every pair of the classes, zeros included."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(int(c),) for c in classes], "label int")
    grid = one.crossJoin(one.withColumnRenamed("label", "predicted"))
    counts = rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    return grid.join(counts, ["label", "predicted"], "left").fillna(0, ["n"])


def report(rows: DataFrame, classes: Sequence[int], names: Mapping[int, str] | None = None) -> DataFrame:
    """Precision, recall, f1 and support of each class asked for, then their macro and weighted means (over all classes asked for)."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(int(c), (names or {}).get(c, str(c))) for c in classes], "cls int, name string")
    scores = asked.join(class_scores(counted(rows.filter(F.col("label").isin(*classes)))), "cls", "left").fillna(0, ["precision", "recall", "f1", "support"])
    kinds = ("precision", "recall", "f1")
    lines = scores.select("name", *kinds, "support")
    macro = scores.agg(F.lit("macro avg").alias("name"), *(F.avg(k).alias(k) for k in kinds), F.sum("support").alias("support"))
    weighted = scores.agg(F.lit("weighted avg").alias("name"), *(F.coalesce(F.try_divide(F.sum(F.col(k) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(k) for k in kinds), F.sum("support").alias("support"))
    return lines.unionByName(macro).unionByName(weighted)
