"""Sweeps over settings: configurations are rows, results are one table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_map
from . import cluster, evaluate
from .matrix import block
from .memory import Settings, recall_block
from .neighbours import Patterns, gathered, gathered_by


def judge_all(cells: DataFrame, configs: Sequence[tuple[Patterns, Settings]]) -> DataFrame:
    """(config, label, predicted, mismatches, width) of every cell under every configuration, in one pass over the cells."""
    held = {id(p): p for p, _ in configs}
    place = {k: n for n, k in enumerate(held)}
    shared = cells.sparkSession.sparkContext.broadcast([(p.classes, p.matrix) for p in held.values()])
    asked = [(place[id(p)], s) for p, s in configs]
    width = configs[0][0].matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch["x"], width)
            for k, (n, s) in enumerate(asked):
                classes, p = shared.value[n]
                y = recall_block(x, 2 * p - 1 if s.binary else p, s)
                d = (y**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * y @ p.T
                best = np.round(d, 9).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), batch["label"], pa.array(classes[best].astype(np.int32)), pa.array((y != p[best]).sum(axis=1)), pa.array(np.full(len(x), width, np.int32))], ["config", "label", "predicted", "mismatches", "width"])

    return arrow_map(cells.select(F.col("label").cast("int").alias("label"), "x"), run, "config int, label int, predicted int, mismatches bigint, width int")


def sweep_settings(cells: DataFrame, patterns: DataFrame | Patterns, betas: Iterable[float], steps: Iterable[int], threshold: float = 0.0) -> DataFrame:
    """Metrics for each pair of beta and steps; cells are read once for all pairs."""
    spark = cells.sparkSession
    grid = [(b, s) for b in betas for s in steps]
    table = spark.createDataFrame([(k, float(b), int(s)) for k, (b, s) in enumerate(grid)], "config int, beta double, steps int")
    held = gathered(patterns)
    judged = judge_all(cells, [(held, Settings(float(b), int(s), True, threshold)) for b, s in grid])
    return evaluate.metrics(judged, by=("config",)).join(table, "config")


def sweep_prototypes(train: DataFrame, cells: DataFrame, configs: Sequence[tuple[Mapping[int, int] | int, int]], settings: Settings, steps: int = 3) -> DataFrame:
    """Metrics for each (clusters of a class, k): prototypes of all configurations are made together, cells are judged in one pass."""
    held = gathered_by(cluster.prototypes_all(train, configs, steps))
    judged = judge_all(cells, [(held[k], settings) for k in range(len(configs))])
    sizes = cells.sparkSession.createDataFrame([(k, len(p)) for k, p in held.items()], "config int, patterns int")
    return evaluate.metrics(judged, by=("config",)).join(F.broadcast(sizes), "config")


def best(results: DataFrame) -> DataFrame:
    """The configuration of highest accuracy, in percent to two digits; the first of equals."""
    return results.withColumn("percent", F.round(100 * F.col("accuracy"), 2)).orderBy(F.desc("percent"), "config").limit(1)
