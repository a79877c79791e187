"""What goes beyond one task or the driver: wide components, seeds by oversampling, patterns and queries in blocks, rows of entries."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import bits
from tessella.functions import vectors as V
from tessella.operators import cluster, matrix, memory, neighbours, packed, project
from tessella.operators.matrix import vectors
from tessella.sources import store


def table(spark, x, **others):
    columns = {"cell_id": pa.array(np.arange(len(x)), pa.int64()), **{k: pa.array(v) for k, v in others.items()}, "x": vectors(np.asarray(x, float))}
    return spark.createDataFrame(pa.table(columns))


def test_components_of_thirty_thousand_features(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((150, 35)) * np.linspace(9, 1, 35)) @ rng.standard_normal((35, 30_000))
    cells = table(spark, x).repartition(6)
    loadings, values = project.uncentred_components(cells, 30_000, 35)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:35], rtol=1e-9)
    assert np.abs(loadings - project.signed(vt[:35].T)).max() < 1e-6
    assert project.residuals(cells, loadings, values).max() < 1e-9
    with pytest.raises(ValueError, match="more than the driver holds"):
        project.leading_components(cells, project.MOST_BASIS_VALUES, 1)


def test_components_of_rows_of_entries(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((90, 40)) < 0.2, rng.integers(1, 5, (90, 40)), 0) * np.linspace(4, 1, 40)
    x[7] = 0
    rows = matrix.to_rows(matrix.to_coordinates(table(spark, x)), table(spark, x))
    assert rows.count() == 90
    loadings, values = project.leading_components(rows, 40, 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:3]) and np.allclose(loadings, project.signed(vt[:3].T), atol=1e-6)
    few = project.leading_components(table(spark, x[:2]), 40, 5)
    assert np.allclose(few[1][:2], np.linalg.svd(x[:2], compute_uv=False)) and np.allclose(few[1][2:], 0)


def test_leading_components_of_close_values(spark):
    """Values so close that a power of X'X doesn't part them: the components themselves must have settled."""
    x = np.random.default_rng(6).standard_normal((3000, 64))
    cells = table(spark, x)
    loadings, values = project.leading_components(cells, 64, 8)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:8], rtol=1e-12)
    assert np.abs(loadings - project.signed(vt[:8].T)).max() < 1e-9
    # Wider than a subspace: it must go on from its best directions.
    wide = np.random.default_rng(7).standard_normal((900, 700)) * np.linspace(2, 1, 700)
    found, sizes = project.leading_components(table(spark, wide), 700, 4)
    _, s, vt = np.linalg.svd(wide, full_matrices=False)
    assert np.allclose(sizes, s[:4], rtol=1e-12) and np.abs(found - project.signed(vt[:4].T)).max() < 1e-9


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2, (2, 6, 32)) * 10.0
    labels, which = rng.integers(0, 2, 900), rng.integers(0, 6, 900)
    x = centres[labels, which] + rng.standard_normal((900, 32)) * 0.1
    order = np.argsort(which, kind="stable")  # cells of least id are all in one blob
    return x[order], labels[order] + 1


def cost(x, labels, centres):
    return sum(cluster.squared(x[labels == g], c).min(axis=1).sum() for g, c in centres.items())


def test_seeds_lie_apart(spark, blobs):
    x, labels = blobs
    cells = table(spark, x, label=labels.astype(np.int32))
    (spread,) = cluster.lloyd_all(cells, cluster.spread_starts(cells, [6]))
    (least,) = cluster.lloyd_all(cells, cluster.starts_of(cells, [6]))
    assert cost(x, labels, spread) < 900 * 32 * 0.02 < cost(x, labels, least) / 100


def test_seeds_depend_on_ids_alone_and_are_prefixes(spark, blobs):
    x, labels = blobs
    cells = table(spark, x, label=labels.astype(np.int32))
    one = cluster.spread_starts(cells, [6, {1: 3, "default": 4}])
    two = cluster.spread_starts(cells.repartition(7, F.col("cell_id") % 5), [6])
    assert all((one[0][g] == two[0][g]).all() for g in (1, 2))
    assert (one[1][1] == one[0][1][:3]).all() and (one[1][2] == one[0][2][:4]).all()


def test_seeds_of_few_different_cells(spark):
    cells = table(spark, [[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 2 + [[5.0, 5.0]], label=np.array([1] * 7 + [3], np.int32))
    (found,) = cluster.spread_starts(cells, [4])
    assert sorted(map(tuple, found[1])) == [(0.0, 0.0), (1.0, 1.0)] and found[3].tolist() == [[5.0, 5.0]]
    protos = cluster.prototypes(cells, 4, 1, starts=cluster.spread_starts)
    assert {(r["cls"], tuple(r["p"])) for r in protos.collect()} >= {(1, (0.0, 0.0)), (1, (1.0, 1.0))}
    assert cluster.spread_starts(cells.limit(0), [4]) == [{}]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 2, (40, 16)).astype(float)
    p[7] = p[3]  # a tie
    patterns = spark.createDataFrame([(k, k % 5, row.tolist()) for k, row in enumerate(p)], "pattern_id int, cls int, p array<double>")
    return patterns, table(spark, rng.integers(0, 2, (60, 16)), label=np.arange(60).astype(np.int32))


@pytest.mark.parametrize("values", [16, 16 * 7, 16 * 1000])
def test_blocks_give_what_one_block_gives(spark, many, values):
    patterns, cells = many
    blocks = neighbours.blocks_of(patterns, values)
    assert len(blocks) == -(-40 // (values // 16))
    rows = lambda df: {r["cell_id"]: tuple(r) for r in df.collect()}
    assert rows(neighbours.nearest_in_blocks(cells, blocks)) == rows(neighbours.nearest_pattern(cells, patterns))
    for settings in (memory.Settings(0.3, 2), memory.Settings(8.0, 1, threshold=0.5), memory.Settings(0.7, 3, binary=False)):
        one, parts = rows(memory.Memory(patterns, settings).recall(cells)), rows(memory.recall_in_blocks(cells, blocks, settings))
        assert all(np.allclose(parts[k][-1], one[k][-1], atol=2e-9) and parts[k][:-1] == one[k][:-1] for k in one)


def test_more_patterns_than_a_task_holds(spark, many, monkeypatch):
    patterns, cells = many
    settings = memory.Settings(0.3, 2)
    expected = {r["cell_id"]: r["x"] for r in memory.Memory(patterns, settings).recall(cells).collect()}
    nearest = {tuple(r) for r in neighbours.nearest_pattern(cells, patterns).select("cell_id", "pattern_id", "mismatches").collect()}
    monkeypatch.setattr(neighbours, "MOST_PATTERN_VALUES", 500)
    assert {r["cell_id"]: r["x"] for r in memory.Memory(patterns, settings).recall(cells).collect()} == expected
    assert {tuple(r) for r in neighbours.nearest_pattern(cells, patterns).select("cell_id", "pattern_id", "mismatches").collect()} == nearest
    with pytest.raises(ValueError, match="empty"):
        memory.recall_in_blocks(cells, [], settings)
    with pytest.raises(ValueError, match="empty"):
        neighbours.nearest_in_blocks(cells, [])


@pytest.mark.parametrize("p", [2.0, 1.0, 0.5, 3.0])
@pytest.mark.parametrize("values", [1 << 22, 100])
def test_nearest_to_each_query(spark, monkeypatch, p, values):
    monkeypatch.setattr(neighbours, "MOST_QUERY_VALUES", values)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (203, 5)).astype(float)  # many ties
    cells = table(spark, x).repartition(5)
    queries = cells.filter("cell_id % 9 = 0").select(F.col("cell_id").alias("query_id"), "x")
    got = {}
    for r in neighbours.nearest_to_each(cells, queries.unionByName(queries.limit(3)), 7, p).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["cell_id"])
    assert set(got) == set(range(0, 203, 9))
    for q, near in got.items():
        d = (np.abs(x - x[q]) ** p).sum(axis=1)
        d = np.round(d ** (1 / p) if p >= 1 else d, 9)
        assert [near[k + 1] for k in range(7)] == sorted(zip(d.tolist(), range(203)))[:7]
    assert neighbours.nearest_to_each(cells.limit(0), queries, 2).count() == 0
    assert neighbours.nearest_to_each(cells, queries.limit(0), 2).count() == 0


def test_rows_of_entries(spark, many):
    patterns, cells = many
    rows = matrix.rows_of(cells)
    assert rows.columns == ["cell_id", "label", "positions", "values"]
    x = {r["cell_id"]: np.array(r["x"]) for r in cells.collect()}
    assert all(r["positions"] == np.flatnonzero(x[r["cell_id"]]).tolist() for r in rows.collect())
    p = np.array([r["p"] for r in patterns.orderBy("pattern_id").collect()])
    there = np.setdiff1d(np.arange(16), [2, 9])
    for r in memory.row_scores(rows, patterns, [2, 9]).collect():
        assert r["scores"] == dict(enumerate(((2 * p[:, there] - 1) @ (2 * x[r["cell_id"]][there] - 1)).tolist()))
    half = cells.withColumn("x", F.transform("x", lambda v, i: F.when(i.isin(2, 9), 0.5).otherwise(v)))
    for settings in (memory.Settings(0.3, 2), memory.Settings(8.0, 1, threshold=0.5)):
        held = memory.Memory(patterns, settings)
        expected = {r["cell_id"]: r["x"] for r in held.recall(half).collect()}
        assert {r["cell_id"]: r["x"] for r in memory.recall_rows(held, rows, [2, 9]).collect()} == expected
    with pytest.raises(ValueError, match="rows of bits"):
        memory.recall_rows(memory.Memory(patterns, memory.Settings(binary=False)), rows)


def test_row_products_in_steps():
    rng = np.random.default_rng(0)
    x = np.where(rng.random((50, 9)) < 0.3, rng.random((50, 9)), 0)
    x[[0, 13, 49]] = 0
    positions, values = pa.array([np.flatnonzero(r) for r in x]), pa.array([r[r != 0] for r in x])
    dense = rng.random((9, 4))
    for step in (1, 13, 1 << 20):
        assert np.allclose(matrix.row_products(positions, values, dense, step), x @ dense)
    assert matrix.row_products(positions[20:30], values[20:30], dense).shape == (10, 4)
    assert np.allclose(matrix.row_products(positions[20:30], values[20:30], dense), x[20:30] @ dense)


def test_unfinished_versions_are_not_read(spark, tmp_path):
    """A writer that dies half way and one that publishes after it; a reader in between keeps what it has."""
    folder, calls = str(tmp_path), []

    def dies():
        calls.append(1)
        return spark.range(10).select((F.lit(1) / F.when(F.col("id") < 9, 1).otherwise(F.raise_error(F.lit("lost")).cast("int"))).alias("v"))

    with pytest.raises(Exception, match="lost"):
        store.published(spark, folder, "t", {"k": 1}, dies)
    (left,) = tmp_path.iterdir()
    (left / "half").mkdir()  # and one that is still at work
    assert store.versions(spark, str(left)) == []
    first = store.published(spark, folder, "t", {"k": 1}, lambda: spark.range(3).toDF("v"))
    spark.range(3).toDF("v").write.parquet(f"{left}/another")  # a second writer, done at the same time
    again = store.published(spark, folder, "t", {"k": 1}, dies)
    assert len(calls) == 1 and first.count() == again.count() == 3


def test_minkowski_agrees_with_the_join(spark):
    cells = table(spark, np.random.default_rng(6).random((20, 4)))
    q = cells.filter("cell_id = 3").select(F.lit(3).alias("query_id"), F.col("x"))
    one = [(r["cell_id"], r["distance"]) for r in neighbours.nearest_to_each(cells, q, 20, 3.0).orderBy("rank").collect()]
    vector = F.array(*map(F.lit, cells.filter("cell_id = 3").first()["x"]))
    assert one == [(r["cell_id"], r["d"]) for r in cells.select("cell_id", F.round(V.minkowski(F.col("x"), vector, 3.0), 9).alias("d")).orderBy("d", "cell_id").collect()]


@pytest.mark.parametrize("width", [1, 64, 70, 130])
def test_packed_bits(spark, width):
    x = np.random.default_rng(width).integers(0, 2, (30, width)).astype(float)
    x[3], x[4] = 1, 0
    cells = packed.packed(table(spark, x, label=(np.arange(30) % 3).astype(np.int32)), width)
    rows = {r["cell_id"]: r for r in cells.withColumns({"x": bits.unpack("words", width), "n": bits.ones("words")}).collect()}
    assert all(len(r["words"]) == bits.words_in(width) and r["x"] == x[k].tolist() and r["n"] == x[k].sum() for k, r in rows.items())
    assert rows[3]["words"][0] == (-1 if width >= 64 else 1)
    profiles = packed.majority_profiles(cells)
    p = {r["cls"]: np.array(r["x"]) for r in profiles.withColumn("x", bits.unpack("words", width)).collect()}
    assert all((p[k] == (x[k::3].mean(axis=0) > 0.5)).all() for k in range(3))
    for r in packed.nearest_pattern(cells, profiles).collect():
        d = [(int((x[r["cell_id"]] != p[k]).sum()), k) for k in range(3)]
        assert (r["mismatches"], r["pattern_id"]) == min(d) and r["active"] == p[r["pattern_id"]].sum()
