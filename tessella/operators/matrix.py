"""The two layouts of a matrix, and conversions between them.

Vector layout: (cell_id, x ARRAY<DOUBLE>), a row for each cell. Coordinate layout: (cell_id, pos, value), a row for each
entry that isn't zero. Wide tables with a column for each feature are never formed: planning them takes longer than
running them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..arrow import arrow_map


def to_coordinates(cells: DataFrame, keep_zeros: bool = False) -> DataFrame:
    rows = cells.select("cell_id", F.posexplode("x").alias("pos", "value"))
    return rows if keep_zeros else rows.filter(F.col("value") != 0)


def to_vectors(entries: DataFrame, width: int, cells: DataFrame | None = None) -> DataFrame:
    """Vectors of ``width`` components; what has no entry is 0. Cells without any entry appear only if ``cells`` lists them.

    A cell's entries are put in order and the gaps between them filled, so work grows with entries and width, not with their
    product. Two entries at one place are an error; entries beyond the width are left out.
    """
    inside = entries.filter((F.col("pos") >= 0) & (F.col("pos") < width)).select("cell_id", F.struct(F.col("pos").cast("int").alias("pos"), F.col("value").cast("double").alias("value")).alias("e"))
    held = inside.groupBy("cell_id").agg(F.array_sort(F.collect_list("e")).alias("held"))
    # After each entry come the zeros up to the next one.
    upto = f"if(i + 1 < size(held), get(held, i + 1).pos, {width})"
    filled = F.expr(f"flatten(transform(held, (e, i) -> concat(array(e.value), array_repeat(0.0D, {upto} - e.pos - 1))))")
    x = F.concat(F.array_repeat(F.lit(0.0), F.expr("held[0].pos")), filled)
    whole = F.when(F.size("x") == width, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("two entries at one place of cell "), F.col("cell_id").cast("string"))))
    made = held.select("cell_id", x.alias("x")).select("cell_id", whole.alias("x"))
    if cells is None:
        return made
    return cells.select("cell_id").join(made, "cell_id", "left").select("cell_id", F.coalesce("x", F.array_repeat(F.lit(0.0), width)).alias("x"))


def to_rows(entries: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, positions, values): a cell's entries in order of position, one row for each cell; ``cells`` lists those without any, too."""
    held = entries.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("value").cast("double").alias("value")))).alias("e"))
    rows = held.select("cell_id", F.col("e.pos").alias("positions"), F.col("e.value").alias("values"))
    if cells is None:
        return rows
    none = F.array().cast("array<int>"), F.array().cast("array<double>")
    return cells.select("cell_id").join(rows, "cell_id", "left").select("cell_id", F.coalesce("positions", none[0]).alias("positions"), F.coalesce("values", none[1]).alias("values"))


def rows_of(cells: DataFrame) -> DataFrame:
    """Vectors as rows of entries (positions, values) of what isn't zero, with the other columns; nothing moves."""
    held = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("pos"), v.alias("value"))), lambda e: e["value"] != 0)
    kept = [c for c in cells.columns if c != "x"]
    return cells.select(*kept, held.alias("e")).select(*kept, F.col("e.pos").alias("positions"), F.col("e.value").alias("values"))


def row_products(positions: pa.Array, values: pa.Array, table: np.ndarray, step: int = 1 << 21) -> np.ndarray:
    """Rows of entries times a table (features x columns), from the entries alone, about ``step`` values at a time."""
    ends = np.concatenate([[0], np.cumsum(positions.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    where, what = positions.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False)
    out, a = np.zeros((len(positions), table.shape[1])), 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + step // max(table.shape[1], 1), "right")) - 1)
        full = a + np.flatnonzero(np.diff(ends[a : b + 1]))
        if len(full):
            own = slice(ends[a], ends[b])
            out[full] = np.add.reduceat(table[where[own]] * what[own, None], ends[full] - ends[a], axis=0)
        a = b
    return out


def unpivot_sums(sums: DataFrame, names: str = "feature_id", values: str = "frequency") -> DataFrame:
    """A one-row table of sums, a column for each feature, as (feature, sum) rows."""
    return sums.unpivot([], sums.columns, names, values)


def block(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow column of vectors as a dense matrix; null components are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def vectors(matrix: np.ndarray) -> pa.Array:
    """A dense matrix as an Arrow column of vectors."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, np.float64).ravel()))


def map_blocks(cells: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int, out: str = "x") -> DataFrame:
    """The columns of cells with ``out`` = fn of the dense blocks of x, batch by batch; the one Arrow kernel of this library."""
    names = [c for c in cells.columns if c != out]
    at = cells.columns.index("x")
    keep = [cells.columns.index(c) for c in names]
    schema = ", ".join([*(f"`{cells.columns[k]}` {cells.schema.fields[k].dataType.simpleString()}" for k in keep), f"`{out}` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), vectors(fn(block(batch.column(at), width)))], [*names, out])

    return arrow_map(cells, run, schema)


def cell_count(cells: DataFrame) -> Column:
    return F.count("*").cast("bigint").alias("cells")


def sum_vectors(parts: DataFrame) -> DataFrame:
    """(key, x): the sum of all vectors of each key, from (key BIGINT, x ARRAY<DOUBLE>).

    Whole vectors move, not a row for each component, and a task holds one sum at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), vectors(total[None, :])], ["key", "x"])

        for batch in batches:
            for k, x in zip(batch["key"].to_pylist(), batch["x"], strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                if k == key:
                    total = total + x
                    continue
                if total is not None:
                    yield row()
                key, total = k, x
        if total is not None:
            yield row()

    return arrow_map(parts.repartition("key").sortWithinPartitions("key"), run, "key bigint, x array<double>")
