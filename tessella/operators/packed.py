"""Profiles, nearest patterns and scores of cells whose bits are packed into words (cell_id, ..., words), all in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bits import WORD, apart, ones, pack, words_in
from .neighbours import too_many


def packed(cells: DataFrame, width: int, x: str = "x", out: str = "words") -> DataFrame:
    """cells with the words of x in its place."""
    return cells.select(*(c for c in cells.columns if c != x), pack(x, width).alias(out))


def from_entries(entries: DataFrame, width: int, cells: DataFrame) -> DataFrame:
    """The columns of cells with the words of their entries (cell_id, pos), which may repeat; a cell without entries has zeros.

    Entries are gathered into words before the shuffle, so that at most one row for each word of a cell leaves a task.
    """
    inside = entries.filter((F.col("pos") >= 0) & (F.col("pos") < width))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("pos") % WORD).cast("int"))
    parts = inside.groupBy("cell_id", F.floor(F.col("pos") / WORD).cast("int").alias("place")).agg(F.bit_or(bit).alias("word"))
    held = parts.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "word"))).alias("held"))
    # A sequence can't be empty, so one word more is made and cut off.
    words = F.slice(F.transform(F.sequence(F.lit(0), F.lit(words_in(width))), lambda k: F.coalesce(F.element_at("held", k), F.lit(0).cast("bigint"))), 1, words_in(width))
    return cells.join(held, "cell_id", "left").select(*cells.columns, words.alias("words"))


def majority_profiles(cells: DataFrame, by: str = "label") -> DataFrame:
    """pattern_id, cls, active and words: for each class, ones where more than half of its cells have one; classes are numbered in their order.

    A cell gives a row for each word, not for each bit, and a task keeps 64 counters for each word of a class.
    """
    rows = cells.select(F.col(by).alias("cls"), F.posexplode("words").alias("place", "word"))
    counts = rows.groupBy("cls", "place").agg(F.count("*").alias("n"), *(F.sum(F.getbit("word", F.lit(i))).alias(f"n{i}") for i in range(WORD)))
    word = F.lit(0).cast("bigint")
    for i in range(WORD):
        word = word.bitwiseOR(F.shiftleft((2 * F.col(f"n{i}") > F.col("n")).cast("bigint"), i))
    words = counts.select("cls", "place", word.alias("word")).groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda e: e["word"]).alias("words"))
    return words.select((F.row_number().over(W.orderBy("cls")) - 1).alias("pattern_id"), "cls", ones("words").alias("active"), "words")


def nearest_pattern(cells: DataFrame, patterns: DataFrame) -> DataFrame:
    """The columns of cells with pattern_id, cls, mismatches and active of the nearest pattern (pattern_id, cls, words); ties go to the least id.

    The patterns, within the bound of a memory, are one broadcast row; a cell is compared with them in place, so no row is made
    for a pair.
    """
    if too_many(patterns.withColumn("p", F.col("words"))):
        raise ValueError("more patterns than a task holds at once")
    told = patterns.agg(F.collect_list(F.struct("pattern_id", "cls", ones("words").alias("active"), F.col("words").alias("own"))).alias("patterns"))
    joined = cells.crossJoin(F.broadcast(told))  # one row
    best = F.array_min(F.transform("patterns", lambda p: F.struct(apart("words", p["own"]).alias("mismatches"), p["pattern_id"].alias("pattern_id"), p["cls"].alias("cls"), p["active"].alias("active"))))
    found = joined.select(*cells.columns, best.alias("best"))
    return found.select(*cells.columns, "best.pattern_id", "best.cls", "best.mismatches", "best.active")


def judged(recalled: DataFrame, patterns: DataFrame, width: int) -> DataFrame:
    """As evaluate.judged, from recalled cells (cell_id, label, words)."""
    found = nearest_pattern(recalled.select("cell_id", "label", "words"), patterns)
    return found.select("cell_id", "label", F.col("cls").alias("predicted"), "pattern_id", "mismatches", F.col("active").alias("active_pattern"), ones("words").alias("active_recall"), F.lit(width).alias("width"))
