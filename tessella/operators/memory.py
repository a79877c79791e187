"""A dense associative memory: store patterns, recall every cell against them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .matrix import block, map_blocks, row_products, vectors
from .neighbours import Patterns, blocks_of, folded, gathered, too_many

#: Weighted sums are rounded so before the threshold: on tied scores their residue would depend on the order of summation.
DIGITS = 9


@dataclass(frozen=True)
class Settings:
    """Inverse temperature, updates, whether vectors are bits, and the threshold of a recalled bit in bipolar space."""

    beta: float = 8.0
    steps: int = 1
    binary: bool = True
    threshold: float = 0.0


@dataclass(frozen=True)
class Memory:
    """Stored patterns (pattern_id, cls, p; a table or gathered) and settings. Bits are kept as bits; recall maps them to -1 and 1."""

    patterns: DataFrame | Patterns
    settings: Settings = Settings()

    def recall(self, cells: DataFrame) -> DataFrame:
        """The columns of cells with x replaced by its recall.

        One step is softmax(beta * x P') P, as two matrix products for each batch of cells, with the patterns broadcast after
        a check of their size; more patterns than a task holds go in blocks. Cells are never shuffled.
        """
        if too_many(self.patterns):
            return recall_in_blocks(cells, blocks_of(self.patterns), self.settings)
        p = gathered(self.patterns).matrix
        if not len(p):
            raise ValueError("the memory is empty")
        settings = self.settings
        shared = cells.sparkSession.sparkContext.broadcast(2 * p - 1 if settings.binary else p)
        return map_blocks(cells, lambda x: recall_block(x, shared.value, settings), p.shape[1])

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the patterns as Parquet and the settings beside them."""
        table = self.patterns
        if isinstance(table, Patterns):
            columns = [pa.array(table.ids.astype(np.int32)), pa.array(table.classes.astype(np.int32)), vectors(table.matrix)]
            table = spark.createDataFrame(pa.table(columns, names=["pattern_id", "cls", "p"]))
        table.write.mode("overwrite").parquet(f"{path}/patterns")
        spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> Memory:
    settings = Settings(**json.loads(spark.read.text(f"{path}/settings").first()[0]))
    return Memory(spark.read.parquet(f"{path}/patterns"), settings)


def recall_block(x: np.ndarray, p: np.ndarray, s: Settings) -> np.ndarray:
    x = 2 * x - 1 if s.binary else x
    for _ in range(s.steps):
        x = weighted(s.beta * np.round(x @ p.T, DIGITS), p)
    return (x > s.threshold).astype(np.float64) if s.binary else x


def recall_in_blocks(cells: DataFrame, blocks: Sequence[DataFrame], s: Settings) -> DataFrame:
    """Memory.recall over patterns in blocks. From block to block go the largest score so far, and the weights and weighted patterns summed relative to it.

    A step is a pass over the cells for each block. Sums come in another order than from one block, so results agree within the
    DIGITS to which they are rounded.
    """
    if not blocks:
        raise ValueError("the memory is empty")
    names = cells.columns
    asked = F.transform("x", lambda v: 2 * v - 1) if s.binary else F.col("x")
    table = cells.select(*(c for c in names if c != "x"), asked.alias("x"))

    def step(x: np.ndarray, state: dict[str, pa.Array], own: Patterns) -> list[pa.Array]:
        p = 2 * own.matrix - 1 if s.binary else own.matrix
        scores = s.beta * np.round(x @ p.T, DIGITS)
        before = state["top"].to_numpy(zero_copy_only=False)
        top = np.maximum(before, scores.max(axis=1))
        fade = np.exp(before - top)
        weights = np.exp(scores - top[:, None])
        held = fade[:, None] * block(state["held"], p.shape[1]) if state["held"].flatten().to_numpy().size else 0
        return [pa.array(top), pa.array(fade * state["weight"].to_numpy(zero_copy_only=False) + weights.sum(axis=1)), vectors(held + weights @ p)]

    for _ in range(s.steps):
        start = {"top": (F.lit(float("-inf")), pa.float64()), "weight": (F.lit(0.0), pa.float64()), "held": (F.array().cast("array<double>"), pa.list_(pa.float64()))}
        found = folded(table, blocks, start, step)
        table = found.select(*(c for c in names if c != "x"), F.transform("held", lambda v: F.round(v / F.col("weight"), DIGITS)).alias("x"))
    if s.binary:
        table = table.withColumn("x", F.transform("x", lambda v: (v > s.threshold).cast("double")))
    return table.select(*names)


def present(p: np.ndarray, absent: Sequence[int]) -> np.ndarray:
    """Bipolar patterns with zeros at absent features: those stand at one half, which is 0 in bipolar space."""
    out = 2 * p - 1
    out[:, list(absent)] = 0
    return out


def row_scores(rows: DataFrame, patterns: DataFrame | Patterns, absent: Sequence[int] = ()) -> DataFrame:
    """The other columns of rows (positions, values: bits) with scores, a map from pattern_id to the bipolar dot product.

    Only entries are multiplied: the score is 2 x p - sum(p) over the features that are there.
    """
    held = gathered(patterns)
    p = present(held.matrix, absent)
    shared = rows.sparkSession.sparkContext.broadcast((held.ids.astype(np.int32), p.T.copy(), p.sum(axis=1)))
    kept = [c for c in rows.columns if c not in ("positions", "values")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table, sums = shared.value
        for batch in batches:
            scores = 2 * row_products(batch["positions"], batch["values"], table) - sums
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(ids))
            told = pa.MapArray.from_arrays(ends, pa.array(np.tile(ids, len(batch))), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), told], [*kept, "scores"])

    fields = [*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "scores map<int, double>"]
    return arrow_map(rows, run, ", ".join(fields))


def recall_rows(memory: Memory, rows: DataFrame, absent: Sequence[int] = ()) -> DataFrame:
    """Memory.recall of rows (positions, values: bits): the other columns with x, the recalled vector. Absent features are never formed.

    The first step's scores come from the entries; what a step recalls is dense, as any recall is.
    """
    held, s = gathered(memory.patterns), memory.settings
    if not len(held) or not s.binary or not s.steps:
        raise ValueError("rows of bits are recalled in steps by a memory of bits that isn't empty")
    p = present(held.matrix, absent)
    shared = rows.sparkSession.sparkContext.broadcast((2 * held.matrix - 1, p.T.copy(), p.sum(axis=1)))
    kept = [c for c in rows.columns if c not in ("positions", "values")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, table, sums = shared.value
        for batch in batches:
            scores = 2 * row_products(batch["positions"], batch["values"], table) - sums
            x = weighted(s.beta * np.round(scores, DIGITS), p)
            for _ in range(s.steps - 1):
                x = weighted(s.beta * np.round(x @ p.T, DIGITS), p)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), vectors((x > s.threshold).astype(np.float64))], [*kept, "x"])

    fields = [*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "x array<double>"]
    return arrow_map(rows, run, ", ".join(fields))


def weighted(scores: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The patterns' mean by the softmax of each row's scores, rounded."""
    if not len(scores):
        return np.zeros((0, p.shape[1]))
    weights = np.exp(scores - scores.max(axis=1, keepdims=True))
    return np.round(weights / weights.sum(axis=1, keepdims=True) @ p, DIGITS)


def bit_scores(entries: DataFrame, sizes: DataFrame, patterns: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """(cell_id, pattern_id, score) of bipolar dot products from nonzero entries alone, all in the JVM.

    With d places present, score = 4 sum(xp) - 2 sum(x) - 2 sum(p) + d. Places that a data set lacks stand at one half, which
    is 0 in bipolar space, so they count for nothing and are never formed. sizes: (cell_id) of all cells; patterns are few
    enough for a memory: an error else.
    """
    if too_many(patterns):
        raise ValueError("more patterns than a memory holds at once")
    ones = patterns.select("pattern_id", F.posexplode("p").alias("pos", "p"))
    if absent is not None:
        ones = ones.join(absent.select("pos"), "pos", "left_anti")
        entries = entries.join(absent.select("pos"), "pos", "left_anti")
    per_pattern = ones.groupBy("pattern_id").agg(F.sum("p").alias("sum_p"), F.count("*").alias("d"))
    per_cell = entries.groupBy("cell_id").agg(F.sum("value").alias("sum_x"))
    both = entries.join(ones.filter("p <> 0"), "pos").groupBy("cell_id", "pattern_id").agg(F.sum(F.col("value") * F.col("p")).alias("both"))
    grid = sizes.select("cell_id").join(per_cell, "cell_id", "left").crossJoin(F.broadcast(per_pattern))  # one row for each cell and pattern: the result's size
    score = 4 * F.coalesce("both", F.lit(0.0)) - 2 * F.coalesce("sum_x", F.lit(0.0)) - 2 * F.col("sum_p") + F.col("d")
    return grid.join(both, ["cell_id", "pattern_id"], "left").select("cell_id", "pattern_id", score.alias("score"))
