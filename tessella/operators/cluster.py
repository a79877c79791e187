"""Deterministic k-means, mean and majority profiles, prototypes of each class."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .matrix import block, sum_vectors, vectors

#: Centres are rounded so, between steps: sums in another order of rows then give the same clusters.
DIGITS = 9


def mean_profiles(cells: DataFrame, by: str) -> DataFrame:
    """(by, pos, mean) over the cells of each group; partial sums come before the shuffle, whose size is groups x features."""
    return cells.select(by, F.posexplode("x").alias("pos", "v")).groupBy(by, "pos").agg(F.avg("v").alias("mean"))


def most_populous(cells: DataFrame, by: str, n: int = 9) -> DataFrame:
    return cells.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def majority_profiles(cells: DataFrame, by: str = "label") -> DataFrame:
    """pattern_id, cls and p: for each class, ones where more than half of its cells have one. Classes are numbered in their order."""
    bits = mean_profiles(cells, by).select(F.col(by).alias("cls"), "pos", F.when(F.col("mean") > 0.5, 1.0).otherwise(0.0).alias("v"))
    p = bits.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("p"))
    return p.select((F.row_number().over(W.orderBy("cls")) - 1).alias("pattern_id"), "cls", "p")


def first_centres(cells: DataFrame, counts: Mapping[int, int] | int, by: str = "label") -> DataFrame:
    """(by, cluster, x): the cells of least id of each class, as many as it has clusters."""
    if isinstance(counts, Mapping):
        table = F.create_map(*(F.lit(v) for k, n in counts.items() if k != "default" for v in (int(k), int(n))))
        wanted = F.coalesce(F.element_at(table, F.col(by)), F.lit(counts.get("default", 10)))
    else:
        wanted = F.lit(int(counts))
    most = max([n for n in counts.values()] + [counts.get("default", 10)]) if isinstance(counts, Mapping) else int(counts)
    # The least ids of each class are picked before the vectors move; with a literal bound each task sends no more than that.
    ranked = cells.select(by, "cell_id").withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("cell_id"))).filter(F.col("place") <= most)
    chosen = ranked.filter(F.col("place") <= wanted).select("cell_id", (F.col("place") - 1).alias("cluster"))
    return cells.join(chosen, "cell_id").select(by, "cluster", "x")


def wanted(counts: Mapping[int, int] | int, cls: int) -> int:
    """The number of clusters of a class."""
    return int(counts.get(cls, counts.get("default", 10))) if isinstance(counts, Mapping) else int(counts)


def centres_of(table: DataFrame, by: str = "label") -> dict[int, np.ndarray]:
    """(by, cluster, x) on the driver; centres (classes x clusters) are the model, and small."""
    out: dict[int, list] = {}
    for r in table.orderBy(by, "cluster").collect():
        out.setdefault(r[by], []).append(r["x"])
    return {k: np.array(v, float) for k, v in out.items()}


def starts_of(cells: DataFrame, counts: Sequence[Mapping[int, int] | int], by: str = "label") -> list[dict[int, np.ndarray]]:
    """The first centres for each of several numbers of clusters, from one pass: a smaller number's are the first of a larger one's."""
    keys = {k for c in counts if isinstance(c, Mapping) for k in c if k != "default"}
    most = {k: max(wanted(c, k) for c in counts) for k in keys} | {"default": max(wanted(c, None) for c in counts)}
    table = centres_of(first_centres(cells, most if keys else most["default"], by), by)
    return [{k: v[: wanted(c, k)] for k, v in table.items()} for c in counts]


def spread_starts(cells: DataFrame, counts: Sequence[Mapping[int, int] | int], by: str = "label", rounds: int = 4) -> list[dict[int, np.ndarray]]:
    """First centres that lie apart, for each of several numbers of clusters, by oversampling in a few passes (k-means||).

    The first candidate of a class is drawn by hashed exponential keys; each further round divides the keys by the squared
    distance to the nearest candidate and takes the 2 k least, which draws cells by that distance without replacement. A
    last pass counts the cells nearest to each candidate. Of the candidates the heaviest comes first, then always the one
    whose weight times squared distance to those chosen is largest, ties by id, so the seeds of fewer clusters are the first
    of those of more. Ids decide, not partitions; a class with fewer different cells than clusters has fewer centres.

    A task keeps 2 k cells of each class, whatever its rows; the driver holds (1 + 2 k rounds) candidates of a class.
    """
    spark = cells.sparkSession
    most = lambda g: max(wanted(c, g) for c in counts)
    own = cells.select(F.col(by).cast("int").alias("g"), "cell_id", "x").filter("g is not null")
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def drawn_cells(r: int) -> dict[int, list[tuple[float, int, np.ndarray]]]:
        """The cells of least keys of each class, given the candidates so far."""
        shared = spark.sparkContext.broadcast({g: x for g, (_, x) in held.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple]] = {}
            for batch in batches:
                if not len(batch):
                    continue
                group, ids, u = (batch[c].to_numpy(zero_copy_only=False) for c in ("g", "cell_id", "u"))
                x = block(batch["x"], len(batch["x"][0]))
                for g in np.unique(group).tolist():
                    own = np.flatnonzero(group == g)
                    d = squared(x[own], shared.value[g]).min(axis=1) if g in shared.value else np.ones(len(own))
                    own, d = own[d > 0], d[d > 0]
                    keys = -np.log(u[own]) / d
                    least = np.lexsort((ids[own], keys))[: 2 * most(g) if r else 1]
                    told = [*best.get(g, ()), *((keys[i], int(ids[own[i]]), x[own[i]]) for i in least)]
                    best[g] = sorted(told, key=lambda t: t[:2])[: 2 * most(g) if r else 1]
            rows = [(g, i, k, v) for g, told in best.items() for k, i, v in told]
            if rows:
                g, i, k, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(i, pa.int64()), pa.array(k, pa.float64()), vectors(np.array(v))], ["g", "cell_id", "key", "x"])

        digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(r), "cell_id").cast("binary")), 1, 8), 16, 10).cast("double")
        keyed = own.withColumn("u", (digest + 0.5) / F.lit(float(1 << 32)))
        rows = arrow_map(keyed, run, "g int, cell_id bigint, key double, x array<double>")
        size = max(2 * most(g) if r else 1 for g in [None, *(k for c in counts if isinstance(c, Mapping) for k in c if k != "default")])
        ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("key", "cell_id"))).filter(F.col("rank") <= size)
        out: dict[int, list] = {}
        for row in ranked.orderBy("g", "rank").collect():
            if row["rank"] <= (2 * most(row["g"]) if r else 1):
                out.setdefault(row["g"], []).append((row["cell_id"], row["x"]))
        return out

    for r in range(rounds + 1):
        for g, told in drawn_cells(r).items():
            ids, x = np.array([i for i, _ in told]), np.array([x for _, x in told], float)
            held[g] = (np.concatenate([held[g][0], ids]), np.concatenate([held[g][1], x])) if g in held else (ids, x)
    for g, (ids, x) in held.items():
        order = np.argsort(ids, kind="stable")  # ties go to the least id
        held[g] = ids[order], x[order]
    weights = cells_of(own, {g: x for g, (_, x) in held.items()})
    chosen = {g: x[apart(x, weights[g], most(g))] for g, (_, x) in held.items()}
    return [{g: x[: wanted(c, g)] for g, x in chosen.items()} for c in counts]


def cells_of(own: DataFrame, centres: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How many cells (g, x) are nearest to each centre of their class; a task sends a number for each."""
    found = cluster_of(own, centres, "g").groupBy("g", "cluster").agg(F.count("*").alias("n")) if centres else None
    out = {g: np.zeros(len(c), np.int64) for g, c in centres.items()}
    for r in found.collect() if found is not None else ():  # a row for each centre
        out[r["g"]][r["cluster"]] = r["n"]
    return out


def apart(x: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Rows of x: the heaviest, then always that of largest weight times squared distance to those before; the first of equals."""
    out: list[int] = []
    nearest = np.full(len(x), np.inf)
    while len(out) < min(k, len(x)):
        far = weights * np.where(np.isinf(nearest), 1.0, nearest)
        best = int(np.round(far, 6).argmax())
        if out and not nearest[best]:
            break
        out.append(best)
        nearest = np.minimum(nearest, squared(x, x[best : best + 1])[:, 0])
    return out


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, rounded."""
    return np.round(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1), DIGITS)


def lloyd(cells: DataFrame, centres: DataFrame, steps: int = 3, by: str = "label") -> dict[int, np.ndarray]:
    """Centres of each class after a fixed number of Lloyd steps from (by, cluster, x)."""
    return lloyd_all(cells, [centres_of(centres, by)], steps, by)[0]


def lloyd_all(cells: DataFrame, starts: Sequence[dict[int, np.ndarray]], steps: int = 3, by: str = "label") -> list[dict[int, np.ndarray]]:
    """Centres of each class after a fixed number of Lloyd steps from each start.

    A step is one pass over the cells for all starts; each task sends a vector of sums and a count for each cluster. A cell goes
    to the nearest centre, the first of equals; a cluster without cells keeps its centre.
    """
    now = [dict(s) for s in starts]
    names = [(n, k, c) for n, s in enumerate(now) for k, v in s.items() for c in range(len(v))]
    if not names:
        return now
    width = next(v.shape[1] for s in now for v in s.values())
    for _ in range(steps):
        shared = cells.sparkSession.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [{k: np.zeros((len(c), width + 1)) for k, c in s.items()} for s in shared.value]
            for batch in batches:
                x, group = block(batch["x"], width), batch["g"].to_numpy(zero_copy_only=False)
                for g in np.unique(group[group == group]).tolist():
                    own = x[group == g]
                    ones = np.column_stack([own, np.ones(len(own))])
                    for total, s in zip(sums, shared.value, strict=True):
                        if g in s:
                            np.add.at(total[g], assigned(own, s[g]), ones)
            flat = np.concatenate([v for s in sums for v in s.values()])
            used = np.flatnonzero(flat[:, -1])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used), vectors(flat[used])], ["key", "x"])

        got = sum_vectors(arrow_map(cells.select(F.col(by).cast("int").alias("g"), "x"), run, "key bigint, x array<double>")).toArrow()
        after = [{k: v.copy() for k, v in s.items()} for s in now]
        for key, x in zip(got["key"].to_pylist(), got["x"], strict=True):
            n, k, c = names[key]
            total = x.values.to_numpy()
            after[n][k][c] = np.round(total[:-1] / total[-1], DIGITS)
        now = after
    return now


def drawn(cells: DataFrame, n: int, starts: int) -> list[np.ndarray]:
    """For each start the n cells that come first in an order drawn from its number, by id; one pass over the ids."""
    every = cells.select("cell_id", F.explode(F.array(*map(F.lit, range(starts)))).alias("start"))
    order = W.partitionBy("start").orderBy(F.md5(F.concat_ws("|", "start", "cell_id").cast("binary")), "cell_id")
    chosen = every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("cell_id", "start")
    found = cells.select("cell_id", "x").join(F.broadcast(chosen), "cell_id").orderBy("start", "cell_id").collect()  # n rows for each start
    return [np.array([r["x"] for r in found if r["start"] == k], float) for k in range(starts)]


def with_restarts(cells: DataFrame, clusters: int = 10, restarts: int = 10, steps: int = 10) -> tuple[np.ndarray, float]:
    """Centres of the whole data set, the best of several starts by the sum of squared distances, and that sum; the first of equals.

    All starts go together: a pass over the cells for each step, whatever the number of starts.
    """
    whole = cells.select("cell_id", F.lit(0).alias("label"), "x")
    found = lloyd_all(whole, [{0: x} for x in drawn(whole, clusters, restarts)], steps)
    costs = spread(whole, [c[0] for c in found])
    best = int(np.argmin(np.round(costs, 6)))
    return found[best][0], float(np.round(costs[best], 6))


def spread(cells: DataFrame, centres: Sequence[np.ndarray]) -> np.ndarray:
    """For each set of centres the sum of squared distances to the nearest one; each task sends a number for each."""
    shared = cells.sparkSession.sparkContext.broadcast(list(centres))
    width = centres[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value))
        for batch in batches:
            x = block(batch["x"], width)
            total += [((x - c[assigned(x, c)]) ** 2).sum() for c in shared.value]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), vectors(total[None, :])], ["key", "x"])

    rows = sum_vectors(arrow_map(cells.select("x"), run, "key bigint, x array<double>")).toArrow()
    return rows["x"][0].values.to_numpy() if len(rows) else np.zeros(len(centres))


def assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, distances rounded, the first of equals."""
    if not len(x):
        return np.zeros(0, np.int64)
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    return np.round(d, DIGITS).argmin(axis=1)


def cluster_of(cells: DataFrame, centres: Mapping[int, np.ndarray], by: str = "label") -> DataFrame:
    """The columns of cells with the number of the nearest centre of their class."""
    shared = cells.sparkSession.sparkContext.broadcast(dict(centres))
    width = next(iter(centres.values())).shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, group = block(batch["x"], width), batch[by].to_numpy(zero_copy_only=False)
            out = np.full(len(x), -1, np.int32)
            for k, c in shared.value.items():
                out[group == k] = assigned(x[group == k], c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "cluster"])

    return arrow_map(cells, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", cluster int")


def nearest_in_class(cells: DataFrame, centres: Mapping[int, np.ndarray], k: int, by: str = "label") -> DataFrame:
    """(by, cluster, cell_id, rank): the k cells of the whole class nearest to each centre; two centres may choose one cell."""
    return nearest_in_classes(cells, [centres], k, by).drop("start")


def nearest_in_classes(cells: DataFrame, centres: Sequence[Mapping[int, np.ndarray]], k: int, by: str = "label") -> DataFrame:
    """(start, by, cluster, cell_id, rank): the same for each of several sets of centres, in one pass.

    Each batch sends its k best for each centre; the window sees only those.
    """
    shared = cells.sparkSession.sparkContext.broadcast([dict(c) for c in centres])
    width = next(v.shape[1] for c in centres for v in c.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, group, ids = block(batch["x"], width), batch["g"].to_numpy(zero_copy_only=False), batch["cell_id"].to_numpy()
            out: list[tuple] = []
            for start, each in enumerate(shared.value):
                for g, cs in each.items():
                    own, who = x[group == g], ids[group == g]
                    for c, centre in enumerate(cs):
                        d = np.round(((own - centre) ** 2).sum(axis=1), DIGITS)
                        best = np.lexsort((who, d))[:k]
                        out += [(start, g, c, i, v) for i, v in zip(who[best].tolist(), d[best].tolist(), strict=True)]
            columns = [*zip(*out, strict=True)] or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["start", "g", "cluster", "cell_id", "d"])

    near = arrow_map(cells.select(F.col(by).cast("int").alias("g"), "cell_id", "x"), run, "start int, g int, cluster int, cell_id bigint, d double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("start", "g", "cluster").orderBy("d", "cell_id"))).filter(F.col("rank") <= k)
    return ranked.select("start", F.col("g").alias(by), "cluster", "cell_id", "rank")


def prototypes(cells: DataFrame, clusters: Mapping[int, int] | int = 10, k: int = 1, steps: int = 3, classes: Sequence[int] | None = None, space: DataFrame | None = None, by: str = "label", starts: Callable = starts_of) -> DataFrame:
    """pattern_id, cls, source_cell_id and p: prototypes of each class.

    Cells are clustered in ``space`` (cell_id, x; the cells' own vectors if none), the pattern is taken from the cells
    themselves: the cell nearest to a centre for k = 1, else the majority of the k nearest. Classes come in the order given,
    those without cells are skipped; within a class patterns come in the order of the clusters. ``starts`` makes the first
    centres: starts_of takes the cells of least id, spread_starts cells that lie apart.
    """
    return prototypes_all(cells, [(clusters, k)], steps, classes, space, by, starts).drop("config")


def prototypes_all(cells: DataFrame, configs: Sequence[tuple[Mapping[int, int] | int, int]], steps: int = 3, classes: Sequence[int] | None = None, space: DataFrame | None = None, by: str = "label", starts: Callable = starts_of) -> DataFrame:
    """config, pattern_id, cls, source_cell_id and p: prototypes for each (clusters of a class, k), numbered from 0.

    All configurations go together: one pass for the first centres, one for each Lloyd step, one for the nearest cells and one
    for the votes. Configurations with the same clusters share their k-means.
    """
    order = list(classes) if classes is not None else [r[0] for r in cells.select(by).filter(F.col(by) != 0).distinct().orderBy(by).collect()]
    own = cells.filter(F.col(by).isin(order))
    placed = own if space is None else own.select("cell_id", by).join(space.select("cell_id", "x"), "cell_id")
    placed = placed.select("cell_id", by, "x")
    different = list({repr(c): c for c, _ in configs}.values())
    centres = lloyd_all(placed, starts(placed, different, by), steps, by)
    near = nearest_in_classes(placed, centres, max(k for _, k in configs), by)
    told = [(n, different.index(c), int(k)) for n, (c, k) in enumerate(configs)]
    asked = cells.sparkSession.createDataFrame(told, "config int, start int, k int")
    chosen = near.join(F.broadcast(asked), "start").filter(F.col("rank") <= F.col("k")).select("config", by, "cluster", "cell_id", "rank")
    votes = chosen.join(cells.select("cell_id", "x"), "cell_id").select("config", by, "cluster", F.posexplode("x").alias("pos", "v")).groupBy("config", by, "cluster", "pos").agg(F.when(F.avg("v") > 0.5, 1.0).otherwise(0.0).alias("v"))
    p = votes.groupBy("config", by, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("p"))
    nearest = chosen.filter("rank = 1").select("config", by, "cluster", F.col("cell_id").alias("source_cell_id"))
    turn = F.array_position(F.array(*map(F.lit, order)), F.col(by))
    numbered = p.join(nearest, ["config", by, "cluster"]).withColumn("pattern_id", F.row_number().over(W.partitionBy("config").orderBy(turn, "cluster")) - 1)
    return numbered.select("config", "pattern_id", F.col(by).alias("cls"), "source_cell_id", "p")

