"""Orthonormal bases, projection, and uncentred principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .matrix import block, map_blocks, sum_vectors, vectors

#: Most features of a matrix of products, which the driver decomposes: 512 MB. Its rows are summed so many at a time.
MOST_FEATURES, ROWS = 8192, 64
#: Wider matrices: most values of the directions that go with a pass, which the driver holds (128 MB; three times as many of a subspace at
#: least); directions beyond those asked for; passes' worth of directions in a subspace at most; rounds, after which it is an error that
#: components haven't settled; values of a dense block; tasks' triangles that go together.
MOST_BASIS_VALUES, FURTHER, MOST_BLOCKS, MOST_ROUNDS, BLOCK_VALUES, TOGETHER = 1 << 24, 16, 8, 1000, 1 << 21, 64
#: A component has settled if what is left of it is so small a part of the distance to the next value, or a rounding of the largest value.
SETTLED, ROUNDING = 1e-10, 1e-13


def orthonormal_basis(features: int, components: int, seed: int = 42) -> np.ndarray:
    """features x components with orthonormal columns, from the QR decomposition of a seeded Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, components)))
    return q * np.sign(np.diag(r))


def hadamard_basis(features: int, components: int) -> np.ndarray:
    """The first columns of the normalised Hadamard matrix; features is a power of two. A basis that SQL can write down."""
    i, j = np.meshgrid(np.arange(features), np.arange(components), indexing="ij")
    return (1.0 - 2.0 * (np.bitwise_count(i & j) % 2)) / np.sqrt(features)


def basis_table(spark: SparkSession, basis: np.ndarray) -> DataFrame:
    """(pos, component, weight) of a basis; its size is that of the model, not of the data."""
    i, j = np.indices(basis.shape)
    return spark.createDataFrame(pa.table({"pos": i.ravel().astype(np.int32), "component": j.ravel().astype(np.int32), "weight": basis.ravel()}))


def orthogonality_error(basis: DataFrame) -> DataFrame:
    """Largest entry of |R'R - I|, from (pos, component, weight)."""
    a, b = basis.alias("a"), basis.alias("b")
    product = a.join(b, F.col("a.pos") == F.col("b.pos")).groupBy(F.col("a.component").alias("i"), F.col("b.component").alias("j")).agg(F.sum(F.col("a.weight") * F.col("b.weight")).alias("v"))
    return product.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("error"))


def project(cells: DataFrame, basis: np.ndarray | None, out: str = "x") -> DataFrame:
    """Each vector times the basis, as one matrix product for each batch. The basis is broadcast: it grows with features, not cells."""
    if basis is None:
        raise ValueError("there is no basis to project on")
    shared = cells.sparkSession.sparkContext.broadcast(np.asarray(basis, np.float64))
    return map_blocks(cells, lambda x: x @ shared.value, basis.shape[0], out)


def project_entries(entries: DataFrame, basis: DataFrame) -> DataFrame:
    """(cell_id, component, value) from coordinates and a basis table: a join on pos and a partial sum, all in the JVM."""
    return entries.join(basis, "pos").groupBy("cell_id", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def gram(cells: DataFrame, width: int) -> np.ndarray:
    """X'X. Every task sends the upper half of one matrix, as vectors of ROWS rows; they are summed in the cluster."""
    if width > MOST_FEATURES:
        raise ValueError(f"products of {width} features are more than the driver holds; project them first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = block(batch["x"], width)
            total += x.T @ x
        for k in range(0, width, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), vectors(total[k : k + ROWS, k:].reshape(1, -1))], ["key", "x"])

    rows = sum_vectors(arrow_map(cells.select("x"), run, "key bigint, x array<double>")).toArrow()
    out = np.zeros((width, width))
    for k, x in zip(rows["key"].to_pylist(), rows["x"], strict=True):
        out[k : k + ROWS, k:] = x.values.to_numpy().reshape(-1, width - k)
    return np.triu(out) + np.triu(out, 1).T


def signed(columns: np.ndarray) -> np.ndarray:
    """The columns, each with its entry of largest size positive."""
    return columns * np.sign(columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])])


def dense_blocks(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The rows of a batch as dense blocks of bounded size, from vectors ``x`` or from ``positions`` and ``values`` of what isn't zero."""
    step = max(1, BLOCK_VALUES // width)
    for a in range(0, len(batch), step):
        part = batch.slice(a, step)
        if "x" in batch.schema.names:
            yield block(part["x"], width)
            continue
        out = np.zeros((len(part), width))
        rows = np.repeat(np.arange(len(part)), part["positions"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out[rows, part["positions"].flatten().to_numpy(zero_copy_only=False)] = part["values"].flatten().to_numpy(zero_copy_only=False)
        yield out


def products_with(cells: DataFrame, basis: np.ndarray) -> np.ndarray:
    """X'(XV) of a basis V in one pass: a task sends a matrix of the basis' shape, whatever its rows, and never one of features x features."""
    width, n = basis.shape
    rows = max(1, BLOCK_VALUES // 8 // n)
    shared = cells.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, n))
        for batch in batches:
            for x in dense_blocks(batch, width):
                total += x.T @ (x @ shared.value)
        for k in range(0, width, rows):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), vectors(total[k : k + rows].reshape(1, -1))], ["key", "x"])

    out = np.zeros((width, n))
    got = sum_vectors(arrow_map(cells, run, "key bigint, x array<double>")).toArrow()
    for k, x in zip(got["key"].to_pylist(), got["x"], strict=True):
        out[k : k + rows] = x.values.to_numpy().reshape(-1, n)
    return out


def triangle(cells: DataFrame, basis: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of XV, by a tree: a task keeps the triangle of its rows, TOGETHER tasks' are decomposed together, then those."""
    width, n = basis.shape
    shared = cells.sparkSession.sparkContext.broadcast(basis)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, n))
        for batch in batches:
            for x in dense_blocks(batch, width):
                r = np.linalg.qr(np.vstack([r, x @ shared.value]), mode="r")
        yield pa.RecordBatch.from_arrays([vectors(r)], ["x"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, n))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, block(batch["x"], n)]), mode="r")
        yield pa.RecordBatch.from_arrays([vectors(r)], ["x"])

    schema = "x array<double>"
    # Rows of a triangle may part: the products R'R of the stacked rows are the same in any order.
    found = arrow_map(arrow_map(cells, own, schema).repartition(TOGETHER), joined, schema).toArrow()
    return np.linalg.qr(block(found["x"].combine_chunks(), n), mode="r") if len(found) else np.zeros((0, n))


def leading_components(cells: DataFrame, width: int, components: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """As uncentred_components, for any number of features: block Lanczos with restarts, in which features x features is never formed.

    cells: vectors (x), or rows of entries (positions, values). A round is a pass over the cells that multiplies
    ``components`` + FURTHER directions at most by X'X; what is new in the products joins the subspace and is the next round's
    directions. A subspace that is full goes on with its best directions. Rounds end when each component has settled, not only
    its value, or when nothing is new. The last pass decomposes XV by a tree of QR decompositions, so that small values don't
    lose half of their digits by squaring. Components of equal value are any basis of their space.
    """
    n = min(components + FURTHER, width)
    if n * width > MOST_BASIS_VALUES:
        raise ValueError(f"{n} directions of {width} features are more than the driver holds")
    most = max(3 * n, min(MOST_BLOCKS * n, MOST_BASIS_VALUES // width))
    cells = cells.select(*(c for c in ("x", "positions", "values") if c in cells.columns))
    basis, products, new = np.zeros((width, 0)), np.zeros((0, 0)), orthonormal_basis(width, n, seed)
    for _ in range(MOST_ROUNDS):
        if basis.shape[1] + new.shape[1] > most:
            basis, products = basis @ turned[:, :n], np.diag(values[:n])
        left, basis = products_with(cells, new), np.hstack([basis, new])
        own = basis.T @ left
        products = np.block([[products, own[: len(products)]], [own.T]])
        products = (products + products.T) / 2
        values, turned = np.linalg.eigh(products)
        values, turned = values[::-1], turned[:, ::-1]
        left -= basis @ own
        left -= basis @ (basis.T @ left)
        q, r = np.linalg.qr(left)
        u, sizes, v = np.linalg.svd(r)
        fresh = sizes > len(values) * np.finfo(float).eps * max(values[0], 0)
        rest = np.linalg.norm(sizes[:, None] * (v @ turned[-new.shape[1] :, :components]), axis=0)
        if not fresh.any() or (rest <= np.maximum(SETTLED * gaps(values)[:components], ROUNDING * values[0])).all():
            break
        new = q @ u[:, fresh]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
    else:
        raise RuntimeError(f"{components} components of {width} features haven't settled in {MOST_ROUNDS} passes")
    basis = np.linalg.qr(basis @ turned[:, :n])[0]
    _, values, turned = np.linalg.svd(triangle(cells, basis), full_matrices=False)
    found = min(components, len(values))
    return signed(basis @ turned[:found].T), values[:found]


def gaps(values: np.ndarray) -> np.ndarray:
    """The distance of each of falling values to its nearest neighbour."""
    between = np.concatenate([[np.inf], values[:-1] - values[1:], [np.inf]])
    return np.minimum(between[:-1], between[1:])


def residuals(cells: DataFrame, loadings: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each component the length of X'Xv - s^2 v, relative to the largest s^2; one pass."""
    cells = cells.select(*(c for c in ("x", "positions", "values") if c in cells.columns))
    return np.linalg.norm(products_with(cells, loadings) - loadings * values**2, axis=0) / max(float(values[0]) ** 2, 1e-300)


def uncentred_components(cells: DataFrame, width: int, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns, by falling singular value) and singular values of the matrix as it is, not centred.

    The sign of a column is fixed by making its entry of largest size positive. At most min(cells, features) columns. Up to
    MOST_FEATURES the products of all features are decomposed; of a wider matrix a number of components must be asked for.
    """
    if width > MOST_FEATURES and components is not None:
        return leading_components(cells, width, components)
    values, columns = np.linalg.eigh(gram(cells, width))
    order = np.argsort(-values, kind="stable")[: min(components or width, width)]
    values, columns = np.sqrt(np.maximum(values[order], 0)), columns[:, order]
    return signed(columns), values


def component_scores(cells: DataFrame, loadings: np.ndarray) -> DataFrame:
    return project(cells, loadings)
