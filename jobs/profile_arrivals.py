"""Keep class profiles and the memory made of them up to date while cells arrive, reading each file of cells once.

    python -m jobs.profile_arrivals --config jobs/profile_arrivals.json --cells CELLS --output OUTPUT

A stream of the files in CELLS (vec_id, embedding, label) that ends when all of them are taken: its checkpoint knows which
files are done, and its state holds, for each class and feature, how many cells there are and how many have a one. The state's
size is classes x features, whatever the number of cells or runs. Each batch writes the profiles anew from the state, and a
batch that broke off is taken again with the same files, so a rerun, after a loss or without anything new, gives the same.

Below ``output`` are ``checkpoint``, ``profiles`` by label, and ``model``, the memory of the labelled classes.

A null label is that of unlabelled cells, 0; a null vector has no features and counts for nothing; cells are counted by row, so
a cell that arrives in two files counts twice. Without any file there is no profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.arrow import settings as session_settings
from tessella.functions.vectors import binarise
from tessella.operators import memory, prepare
from tessella.operators.neighbours import gathered
from tessella.sources.store import exists
from tessella.streaming.recall import cells_stream

from .command import LOG, main, written

SCHEMA = "pos int, cells bigint, ones bigint, mean double, major int, label int"


@dataclass(frozen=True)
class Settings:
    """Files of a batch, partitions of the state (fixed by the first run), and the memory's settings."""

    files_per_batch: int = 100
    state_partitions: int = 16
    beta: float = 8.0
    steps: int = 1
    threshold: float = 0.5


def everything_at(path: str) -> str:
    """A pattern that names just this path: a stream takes a folder of files or a single one by it."""
    return f"{path[:-1]}[{path[-1]}]"


def profiles_of(cells: DataFrame) -> DataFrame:
    """(label, pos, cells, ones, mean, major) of each class and feature; partial counts come before the shuffle."""
    bits = cells.select(F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), F.col("vec_id").alias("cell_id"), binarise("embedding").alias("x"))
    values = bits.select("label", F.posexplode("x").alias("pos", "value"))
    counts = values.groupBy("label", "pos").agg(F.count("*").alias("cells"), F.sum("value").cast("bigint").alias("ones"))
    mean = F.col("ones") / F.col("cells")
    return counts.select("pos", "cells", "ones", F.round(mean, 6).alias("mean"), (2 * F.col("ones") > F.col("cells")).cast("int").alias("major"), "label")


def patterns_of(profiles: DataFrame) -> DataFrame:
    """pattern_id, cls and p of the labelled classes, which are numbered by their label."""
    p = prepare.labelled(profiles).groupBy(F.col("label").alias("cls")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "major"))), lambda e: e["major"].cast("double")).alias("p"))
    return p.select(F.col("cls").alias("pattern_id"), "cls", "p")


def run(spark: SparkSession, cells: str, output: str, settings: Settings) -> DataFrame:
    """Take what is new; returns the profiles as they stand in their folder."""
    path = f"{output}/profiles"

    def take(batch: DataFrame, number: int) -> None:
        LOG.info("batch %s", number)
        written(batch, path, "label")

    schema = spark.read.parquet(cells).schema
    with session_settings(spark, {"spark.sql.shuffle.partitions": str(settings.state_partitions)}):
        arriving = cells_stream(spark, everything_at(cells), schema, settings.files_per_batch)
        stream = profiles_of(arriving).writeStream.outputMode("complete").option("checkpointLocation", f"{output}/checkpoint").foreachBatch(take)
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
    LOG.info("read %s new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), cells)
    if not exists(spark, path):
        LOG.info("no cells have arrived so far")
        return spark.createDataFrame([], SCHEMA)
    profiles = spark.read.schema(SCHEMA).parquet(path)
    if not prepare.labelled(profiles).isEmpty():
        held = memory.Memory(gathered(patterns_of(profiles)), memory.Settings(settings.beta, settings.steps, True, settings.threshold))
        held.save(spark, f"{output}/model")
        LOG.info("a memory of %s patterns", len(held.patterns))
    return profiles


if __name__ == "__main__":
    main(__doc__, ("cells",), Settings, run)
