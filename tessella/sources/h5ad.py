"""Annotated matrices in HDF5 (.h5ad) as a Spark data source, in and out; no process holds the matrix.

Reading: a path is a file, or a folder of files that are one data set, cell after cell in the order of their names. Partitions are
ranges of a file's rows (of columns, where X is stored by columns), and a task reads the chunks of its range only. Sparse and
dense X are read. Writing: each task writes one whole file with a range of the cells, and Spark's commit gives the files their
names; a task that is lost leaves nothing that a reader sees.

The path must be one that all executors can open.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .dataset import DataSet
from .hdf5 import Dataset, File
from .hdf5_parts import Parts
from .store import temporary

#: Rows of a partition; entries of a batch, at most a row more; elements of a chunk that is written.
ROWS, ENTRIES, CHUNK = 5000, 1 << 20, 1 << 16
#: Names that a task holds at a time.
NAMES = 1 << 14
SCHEMAS = {"entries": "cell_id bigint, pos int, value double", "cells": "cell_id bigint, cell_key string", "features": "feature_name string, pos int"}


def local(path: str) -> str:
    """A path that open() takes; other file systems can't be opened by tasks."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is in no file system that tasks can open")
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path


def files_at(path: str) -> list[str]:
    """The file itself, or those of a folder by name."""
    path = local(path)
    if not os.path.isdir(path):
        return [path]
    return [os.path.join(path, n) for n in sorted(os.listdir(path)) if n.endswith(".h5ad") and not n.startswith((".", "_"))]


def index_of(table) -> Dataset:
    """The names of a table's rows: the column that its attribute _index names."""
    return table[table.attrs.get("_index", "_index")]


def by_columns(x) -> bool:
    """Whether a sparse X is stored column after column."""
    return not isinstance(x, Dataset) and x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr")).startswith("csc")


class Rows(InputPartition):
    """A range of a file's rows, or columns, and the number of cells before the file."""

    def __init__(self, path: str, first: int, end: int, before: int):
        super().__init__((path, first, end, before))


class H5adReader(DataSourceReader):
    def __init__(self, path: str, what: str):
        self.path, self.what = path, what

    def partitions(self) -> list[Rows]:
        out, before = [], 0
        for path in files_at(self.path):
            with File.opened(path) as file:
                cells = len(index_of(file["obs"]))
                across = self.what == "features" or (self.what == "entries" and by_columns(file["X"]))
                n = len(index_of(file["var"])) if across else cells
            out += [Rows(path, a, min(a + ROWS, n), before) for a in range(0, n, ROWS)]
            before += cells
            if self.what == "features":
                break  # all files of a data set have the same
        return out or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        path, first, end, before = partition.value
        if first == end:
            return
        with File.opened(path) as file:
            if self.what == "features":
                yield pa.RecordBatch.from_arrays([pa.array(index_of(file["var"])[first:end], pa.string()), pa.array(np.arange(first, end, dtype=np.int32))], ["feature_name", "pos"])
            elif self.what == "cells":
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(before + first, before + end, dtype=np.int64)), pa.array(index_of(file["obs"])[first:end], pa.string())], ["cell_id", "cell_key"])
            else:
                x = file["X"]
                for row, column, value in entries_of(x, first, end):
                    cell, pos = (column, row) if by_columns(x) else (row, column)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64) + before), pa.array(pos.astype(np.int32)), pa.array(value.astype(np.float64))], ["cell_id", "pos", "value"])


def entries_of(x, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of the rows' entries that aren't zero, a bounded number at a time (of columns, if X is stored by columns)."""
    if hasattr(x, "shape"):
        step = max(1, ENTRIES // max(x.shape[1], 1))
        for a in range(first, end, step):
            part = np.asarray(x[a : min(a + step, end)])
            i, j = np.nonzero(part)
            yield i + a, j, part[i, j]
        return
    indptr, indices, data = x["indptr"], x["indices"], x["data"]
    ends = np.asarray(indptr[first : end + 1]).astype(np.int64)
    a = first
    while a < end:
        b = max(a + 1, first + int(np.searchsorted(ends, ends[a - first] + ENTRIES, "right")) - 1)
        own = ends[a - first : b - first + 1]
        value = np.asarray(data[own[0] : own[-1]])
        row, column = np.repeat(np.arange(a, b), np.diff(own)), np.asarray(indices[own[0] : own[-1]])
        yield row[value != 0], column[value != 0], value[value != 0]
        a = b


@dataclass
class Written(WriterCommitMessage):
    """A task's file under its first name, its place among the files, and its rows."""

    made: str
    number: int
    rows: int


class Column:
    """A data set that grows by values, a chunk at a time."""

    def __init__(self, parts: Parts, kind: str, side: int | None = None):
        self.parts, self.kind, self.chunks, self.length, self.held = parts, np.dtype(kind), [], 0, []
        self.side = side or CHUNK

    def add(self, values: np.ndarray) -> None:
        self.held.append(values.astype(self.kind))
        self.length += len(values)
        if sum(map(len, self.held)) >= self.side:
            self._write(self.side)

    def _write(self, least: int) -> None:
        rest = np.concatenate(self.held)
        while len(rest) >= least and len(rest):
            own, rest = rest[: self.side], rest[self.side :]
            self.chunks.append(self.parts.chunk(np.concatenate([own, np.zeros(self.side - len(own), self.kind)])))
        self.held = [rest]

    def close(self, **attributes: str) -> int:
        if self.held:
            self._write(1)
        return self.parts.column(self.kind, self.length, self.chunks, self.side, attributes)


def frame(parts: Parts, names: Iterator[list[str]], widest: int) -> int:
    """A table with an index alone, from lists of names of ``widest`` bytes at most; a list at a time is held."""
    column = Column(parts, f"S{widest or 1}", max(1, min(CHUNK, NAMES)))
    for some in names:
        if some:
            column.add(np.array([n.encode() for n in some], column.kind))
    index = column.close(**{"encoding-type": "string-array", "encoding-version": "0.2.0"})
    told = {"_index": "_index", "encoding-type": "dataframe", "encoding-version": "0.2.0", "column-order": np.zeros(0)}
    return parts.group({"_index": index}, told)


def names_at(path: str) -> Iterator[list[str]]:
    """The names of the cells at a path, in order, a bounded number at a time."""
    for name in files_at(path):
        with File.opened(name) as file:
            index = index_of(file["obs"])
            for a in range(0, len(index), NAMES):
                yield index[a : min(a + NAMES, len(index))]


class H5adWriter(DataSourceArrowWriter):
    def __init__(self, path: str, features: str, number: int, widest: int, overwrite: bool):
        self.path, self.features, self.number, self.widest, self.overwrite = local(path), features, number, widest, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file from (cell_key, positions, values) of a range of cells."""
        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        made = os.path.join(self.path, f".{self.run}-{context.taskAttemptId()}")
        keys: list[pa.Array] = []
        with open(made, "wb") as sink:
            parts = Parts(sink)
            indptr, indices, data = Column(parts, "<i8"), Column(parts, "<i4"), Column(parts, "<f8")
            indptr.add(np.zeros(1))
            for batch in iterator:
                keys.append(batch["cell_key"])
                ends = batch["positions"].value_lengths().to_numpy(zero_copy_only=False)
                indptr.add(data.length + np.cumsum(ends))
                indices.add(batch["positions"].flatten().to_numpy(zero_copy_only=False))
                data.add(batch["values"].flatten().to_numpy(zero_copy_only=False))
            widest = max((pc.max(pc.binary_length(k)).as_py() or 0 for k in keys if len(k)), default=1)
            shape = np.array([rows := sum(map(len, keys)), self.number])
            sparse = {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": shape}
            x = parts.group({"data": data.close(), "indices": indices.close(), "indptr": indptr.close()}, sparse)
            root = {"X": x, "obs": frame(parts, (k.slice(a, NAMES).to_pylist() for k in keys for a in range(0, len(k), NAMES)), widest), "var": frame(parts, names_at(self.features) if self.features else iter(()), self.widest)}
            parts.close(parts.group(root, {"encoding-type": "anndata", "encoding-version": "0.1.0"}))
        return Written(made, context.partitionId(), rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Give the files their names, but to those without cells, of which one stays if there is no other; files of an earlier write go before."""
        told = sorted((m for m in messages if m is not None), key=lambda m: (-m.rows, m.number))
        kept = [m for m in told if m.rows] or told[:1]
        if self.overwrite:
            for path in files_at(self.path):
                os.remove(path)
        for m in told:
            if m in kept:
                os.rename(m.made, os.path.join(self.path, f"part-{m.number:05d}-{self.run}.h5ad"))
            else:
                os.remove(m.made)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.made):
                os.remove(m.made)


class H5ad(DataSource):
    """spark.read.format("h5ad").option("what", "entries" | "cells" | "features").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def _what(self) -> str:
        what = self.options.get("what", "entries")
        if what not in SCHEMAS:
            raise ValueError(f"an .h5ad file has no {what}")
        return what

    def schema(self) -> str:
        return SCHEMAS[self._what()]

    def reader(self, schema) -> H5adReader:
        return H5adReader(self.options["path"], self._what())

    def writer(self, schema, overwrite: bool) -> H5adWriter:
        return H5adWriter(self.options["path"], self.options.get("features", ""), int(self.options.get("number", 0)), int(self.options.get("widest", 1)), overwrite)


def read_h5ad(spark: SparkSession, path: str) -> DataSet:
    """The data set of a file or folder; write it as Parquet to read it more than once."""
    spark.dataSource.register(H5ad)
    part = lambda what: spark.read.format("h5ad").option("what", what).load(path)
    return DataSet(part("cells"), part("features"), part("entries"))


def write_h5ad(data: DataSet, path: str, key: str = "cell_key", files: int | None = None) -> None:
    """Write a data set as a folder of .h5ad files, cells in the order of cell_id; entries at one place must be one..

    Features take places in the order of their positions. Their names are first written as the cells of a data set of their own in
    the shared folder, which tasks must be able to open and from which each copies them into its file, a bounded number at a time; entries go straight from the
    shuffle that brings a cell's together to the files.
    """
    spark = data.cells.sparkSession
    spark.dataSource.register(H5ad)
    folder = temporary(spark, "features")
    ranged = data.features.select("pos", F.coalesce("feature_name", F.lit("")).alias("feature_name")).repartitionByRange("pos").sortWithinPartitions("pos").select("pos", "feature_name", F.spark_partition_id().alias("part"))
    ranged.write.parquet(f"{folder}/ranged")
    ranged = spark.read.schema(ranged.schema).parquet(f"{folder}/ranged")
    # Places are counted within each range, and the ranges before it are added.
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = ranged.withColumn("within", F.row_number().over(W.partitionBy("part").orderBy("pos")) - 1).join(F.broadcast(before), "part")
    places = placed.select("pos", (F.col("within") + F.col("before")).cast("int").alias("place"))
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    named = ranged.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("feature_name").alias("cell_key"), none[0].alias("positions"), none[1].alias("values"))
    named.write.format("h5ad").mode("overwrite").save(f"{folder}/names")
    told = ranged.agg(F.count("*").alias("n"), F.max(F.octet_length("feature_name")).alias("widest")).first()
    held = data.entries.join(places, "pos").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value")))).alias("e"))
    cells = data.cells.select("cell_id", F.col(key).cast("string").alias("cell_key")).join(held, "cell_id", "left")
    none = F.array().cast("array<struct<place: int, value: double>>")
    rows = cells.select("cell_id", F.coalesce("cell_key", F.lit("")).alias("cell_key"), F.coalesce("e", none).alias("e"))
    ranged = rows.repartitionByRange(files, "cell_id") if files else rows.repartitionByRange("cell_id")
    shown = ranged.sortWithinPartitions("cell_id").select("cell_key", F.col("e.place").alias("positions"), F.col("e.value").alias("values"))
    shown.write.format("h5ad").options(features=f"{folder}/names", number=told["n"], widest=told["widest"] or 1).mode("overwrite").save(path)
