"""Recall on a stream. A cell's recall needs the memory and nothing else, so the batch operator runs unchanged and keeps no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.memory import Memory


def cells_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of cells (cell_id, ..., x) as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def recall_stream(memory: Memory, cells: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each arriving cell's recall to a folder of Parquet files, exactly once. once: end when all that is there has been done."""
    writer = memory.recall(cells).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
