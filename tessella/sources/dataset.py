"""A data set as three Parquet tables: cells, features and entries. Each is read alone, so names cost no read of the matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DataSet:
    """cells (cell_id, ...), features (feature_name, pos) and entries (cell_id, pos, value)."""

    cells: DataFrame
    features: DataFrame
    entries: DataFrame

    def write(self, path: str, mode: str = "error") -> None:
        """Write all three; the entries are clustered by position within files, so that statistics prune column selections."""
        self.cells.write.mode(mode).parquet(f"{path}/cells")
        self.features.write.mode(mode).parquet(f"{path}/features")
        self.entries.sortWithinPartitions("pos", "cell_id").write.mode(mode).parquet(f"{path}/entries")


def read_dataset(spark: SparkSession, path: str) -> DataSet:
    return DataSet(*(spark.read.parquet(f"{path}/{name}") for name in ("cells", "features", "entries")))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features alone."""
    return spark.read.parquet(f"{path}/features")


def read_table(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A narrow CSV under a given schema; what doesn't fit it is an error."""
    return spark.read.csv(path, schema=schema, header=header, sep=separator, mode="FAILFAST", enforceSchema=False)
