"""Nearest rows to a query, nearest pattern to each row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrow import arrow_map
from ..functions.vectors import minkowski
from ..sources.store import temporary
from .matrix import block

#: Patterns, and their values, that fit into a task: 512 MB. Patterns are a model's, mostly far fewer; beyond that they go in blocks.
MOST_PATTERNS, MOST_PATTERN_VALUES = 1 << 16, 1 << 26
#: Values of the queries, and of their nearest, that go together in a search for many queries: 32 MB.
MOST_QUERY_VALUES = 1 << 22


def query_vector(cells: DataFrame, query: Sequence, width: int) -> list[float]:
    """The vector meant by a query: one vector; several vectors, whose mean is taken; or ids of cells, whose mean is taken.

    Ids are told from a vector by type (integers), never by length.
    """
    if len(query) and isinstance(query[0], Sequence | np.ndarray):
        return np.mean(np.asarray(query, float), axis=0).tolist()
    if len(query) and all(isinstance(q, int | np.integer) for q in query):
        chosen = cells.filter(F.col("cell_id").isin([int(q) for q in query])).select(F.posexplode("x").alias("pos", "v"))
        means = {r["pos"]: r["m"] for r in chosen.groupBy("pos").agg(F.avg("v").alias("m")).collect()}
        return [means[p] for p in range(width)]
    return [float(q) for q in query]


def nearest(cells: DataFrame, query: Sequence[float], k: int = 1, distance: float = 2.0) -> DataFrame:
    """The k cells nearest to a vector, with distance and rank from 1; ties by cell. Each task keeps k rows."""
    vector = F.array(*(F.lit(float(v)) for v in query))
    best = cells.select("cell_id", F.round(minkowski(F.col("x"), vector, distance), 9).alias("distance")).orderBy("distance", "cell_id").limit(k)
    return best.select("cell_id", "distance", F.row_number().over(W.orderBy("distance", "cell_id")).alias("rank"))


def nearest_to_each(cells: DataFrame, queries: DataFrame, k: int = 1, distance: float = 2.0) -> DataFrame:
    """(query_id, cell_id, distance, rank): the k cells nearest to each query (query_id, x), ties by cell.

    Queries go in blocks of MOST_QUERY_VALUES values, each a pass over the cells. A task keeps the k nearest so far for each
    query of the block and sends those, so tasks x queries rows are shuffled and never cells x queries. A query that comes
    twice under one id is asked once.
    """
    spark = cells.sparkSession
    asked = queries.groupBy("query_id").agg(F.min("x").alias("x"))
    told = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(1)).alias("width")).first()
    blocks = max(1, -(-told["n"] * (told["width"] + 2 * k) // MOST_QUERY_VALUES))
    schema = "query_id bigint, near array<struct<distance: double, cell_id: bigint>>"
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        shared = spark.sparkContext.broadcast((own["query_id"].to_numpy(), block(own["x"].combine_chunks(), told["width"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, points = shared.value
            far, who = np.full((len(names), k), np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
            for batch in batches:
                if len(batch):
                    keep_nearest(block(batch["x"], points.shape[1]), batch["cell_id"].to_numpy(), points, distance, far, who)
            near = [[{"distance": d, "cell_id": c} for d, c in zip(*pair, strict=True) if d < np.inf] for pair in zip(far.tolist(), who.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(near, pa.list_(pa.struct([("distance", pa.float64()), ("cell_id", pa.int64())])))], ["query_id", "near"])

        parts.append(arrow_map(cells.select(F.col("cell_id").cast("bigint"), "x"), run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("place", "n")).select("query_id", F.col("n.cell_id"), F.col("n.distance"), (F.col("place") + 1).alias("rank"))


def keep_nearest(x: np.ndarray, ids: np.ndarray, points: np.ndarray, p: float, far: np.ndarray, who: np.ndarray) -> None:
    """Bring the k nearest rows of each point, with distances (far) and ids (who), up to date with a block of rows.

    For p = 2 one matrix product tells which rows can be near enough; the distances of those are then formed from differences,
    as a product loses digits of small ones.
    """
    k = far.shape[1]
    if p == 2:
        squares_of = (x**2).sum(axis=1)
        rough = squares_of[None, :] + (points**2).sum(axis=1)[:, None] - 2 * points @ x.T
        slack = 1e-9 * (1 + squares_of.max() + (points**2).sum(axis=1))
    for q, point in enumerate(points):
        own = np.arange(len(x))
        if p == 2:
            # The k-th least rough square of the block bounds its k nearest, the k-th distance so far those that count.
            kth = np.partition(rough[q], k - 1)[k - 1] if len(x) > k else np.inf
            own = np.flatnonzero(rough[q] <= min(kth, (far[q, -1] + 1e-9) ** 2) + slack[q])
        sums = (np.abs(x[own] - point) ** p).sum(axis=1)
        d = np.concatenate([far[q], np.round(sums ** (1 / p) if p >= 1 else sums, 9)])
        c = np.concatenate([who[q], ids[own]])
        best = np.lexsort((c, d))[:k]
        far[q], who[q] = d[best], c[best]


@dataclass(frozen=True)
class Patterns:
    """The patterns of a memory on the driver: ids in ascending order, classes, and one vector for each."""

    ids: np.ndarray
    classes: np.ndarray
    matrix: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def gathered(patterns: DataFrame | Patterns) -> Patterns:
    """Patterns (pattern_id, cls, p) brought to the driver by one job, within a bound on their number and values."""
    if isinstance(patterns, Patterns):
        return patterns
    return gathered_by(patterns.withColumn("config", F.lit(0))).get(0, Patterns(np.zeros(0, int), np.zeros(0, int), np.zeros((0, 0))))


def gathered_by(patterns: DataFrame) -> dict[int, Patterns]:
    """Patterns (config, pattern_id, cls, p) of each configuration, by one job and within the bound for all together."""
    table = patterns.select("config", "pattern_id", "cls", "p").limit(MOST_PATTERNS + 1).toArrow()
    width = len(table["p"][0]) if len(table) else 0
    if len(table) > MOST_PATTERNS or len(table) * width > MOST_PATTERN_VALUES:
        raise ValueError(f"{len(table)} patterns or more, of {width} values, are more than a memory holds")
    config, ids, classes = (table[c].to_numpy() for c in ("config", "pattern_id", "cls"))
    matrix = block(table["p"].combine_chunks(), width)
    out = {}
    for k in np.unique(config).tolist():
        own = np.flatnonzero(config == k)
        own = own[np.argsort(ids[own], kind="stable")]
        out[k] = Patterns(ids[own], classes[own], matrix[own])
    return out


def blocks_of(patterns: DataFrame, values: int | None = None) -> list[DataFrame]:
    """The patterns in parts of about ``values`` values each (a quarter of what a task holds, if none is given), dealt by their ids."""
    told = patterns.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("p")), F.lit(0)).alias("width")).first()
    size = max(1, min(MOST_PATTERNS, (values or MOST_PATTERN_VALUES) // max(told["width"], 1)) // (1 if values else 4))
    n = -(-told["n"] // size)
    part = F.pmod(F.xxhash64("pattern_id"), F.lit(max(n, 1)))
    return [patterns.filter(part == k) for k in range(n)]


def too_many(patterns: DataFrame | Patterns) -> bool:
    """Whether patterns go beyond what a task holds at once; then they are taken in blocks."""
    if isinstance(patterns, Patterns):
        return False
    told = patterns.agg(F.count("*").alias("n"), F.sum(F.size("p").cast("bigint")).alias("values")).first()
    return told["n"] > MOST_PATTERNS or (told["values"] or 0) > MOST_PATTERN_VALUES


def folded(cells: DataFrame, blocks: Sequence[DataFrame], start: dict[str, tuple[F.Column, pa.DataType]], step: Callable[[np.ndarray, dict[str, pa.Array], Patterns], list[pa.Array]]) -> DataFrame:
    """cells with running state, carried from one block of patterns to the next: a pass over the cells for each block, and no shuffle.

    start: the state's columns with their first values and types; step: the state after a block, from the cells' vectors, the
    state before, and the block. Between passes the cells are a table in the shared folder, so a task holds one block.
    """
    spark, path = cells.sparkSession, temporary(cells.sparkSession, "blocks")
    table = cells.select("*", *(c.alias(n) for n, (c, _) in start.items()))
    kinds = {n: kind for n, (_, kind) in start.items()}
    for k, patterns in enumerate(blocks):
        shared = spark.sparkContext.broadcast(gathered(patterns))
        names = table.columns

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                if not len(own) or not len(batch):
                    yield batch
                    continue
                after = dict(zip(kinds, step(block(batch["x"], own.matrix.shape[1]), {n: batch[n] for n in kinds}, own), strict=True))
                yield pa.RecordBatch.from_arrays([after[n].cast(kinds[n]) if n in after else batch[n] for n in names], names)

        schema = table.schema
        table = arrow_map(table, run, schema)
        if k + 1 < len(blocks):
            table.write.parquet(f"{path}/{k}")
            table = spark.read.schema(schema).parquet(f"{path}/{k}")
    return table


def nearest_in_blocks(cells: DataFrame, blocks: Sequence[DataFrame]) -> DataFrame:
    """nearest_pattern over patterns in blocks: the least distance so far, and the least id that has it, go from block to block."""
    if not blocks:
        raise ValueError("the memory is empty")

    def step(x: np.ndarray, state: dict[str, pa.Array], own: Patterns) -> list[pa.Array]:
        before = {n: state[n].to_numpy(zero_copy_only=False) for n in state}
        d = squares(x, own.matrix)
        best = d.argmin(axis=1)
        d, ids = d[np.arange(len(x)), best], own.ids[best]
        better = (d < before["distance"]) | ((d == before["distance"]) & (ids < before["pattern_id"]))
        now = {"distance": d, "pattern_id": ids, "cls": own.classes[best], "mismatches": (x != own.matrix[best]).sum(axis=1), "active": own.matrix[best].sum(axis=1).astype(np.int64)}
        return [pa.array(np.where(better, now[n], before[n])) for n in before]

    whole = lambda kind: F.lit(0).cast(kind)
    start = {"distance": (F.lit(float("inf")), pa.float64()), "pattern_id": (whole("int"), pa.int32()), "cls": (whole("int"), pa.int32()), "mismatches": (whole("bigint"), pa.int64()), "active": (whole("bigint"), pa.int64())}
    return folded(cells, blocks, start, step).drop("distance")


def squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of rows to patterns by one matrix product, rounded."""
    return np.round((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None, :] - 2 * x @ p.T, 9)


def nearest_pattern(cells: DataFrame, patterns: DataFrame | Patterns) -> DataFrame:
    """The columns of cells with pattern_id, cls, mismatches and active (ones in the pattern) of the nearest pattern; ties go to the least id.

    Squared distances come from one matrix product for each batch of cells. More patterns than a task holds go in blocks.
    """
    if too_many(patterns):
        return nearest_in_blocks(cells, blocks_of(patterns))
    held = gathered(patterns)
    if not len(held):
        raise ValueError("the memory is empty")
    shared = cells.sparkSession.sparkContext.broadcast((held.ids, held.classes, held.matrix))
    width = held.matrix.shape[1]

    def run(batches):
        ids, classes, p = shared.value
        for batch in batches:
            x = block(batch["x"], width)
            best = squares(x, p).argmin(axis=1) if len(x) else np.zeros(0, int)
            wrong = (x != p[best]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[best].astype(np.int32)), pa.array(classes[best].astype(np.int32)), pa.array(wrong.astype(np.int64)), pa.array(p[best].sum(axis=1).astype(np.int64))], [*batch.schema.names, "pattern_id", "cls", "mismatches", "active"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return arrow_map(cells, run, f"{fields}, pattern_id int, cls int, mismatches bigint, active bigint")
