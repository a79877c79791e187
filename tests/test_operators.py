"""Hand-made matrices with answers worked out by hand, and invariants."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.operators import cluster, evaluate, harmonise, matrix, memory, neighbours, prepare, project, select, sweep


def cells(spark, rows, labels=None):
    labels = labels or [1] * len(rows)
    return spark.createDataFrame([(i, l, [float(v) for v in r]) for i, (r, l) in enumerate(zip(rows, labels, strict=True))], "cell_id bigint, label int, x array<double>")


def vectors(df):
    return {r["cell_id"]: r["x"] for r in df.collect()}


def test_binarise_edges(spark):
    df = cells(spark, [[-1, 0, 1e-9, 3, math.nan]])
    assert vectors(prepare.binarise_cells(df)) == {0: [0, 0, 1, 1, 0]}
    entries = matrix.to_coordinates(df)
    assert sorted(r["pos"] for r in prepare.binarise_entries(entries).collect()) == [2, 3]


def test_layouts_round_trip(spark):
    df = cells(spark, [[0, 1, 0], [0, 0, 0], [1, 1, 1]])
    assert vectors(matrix.to_vectors(matrix.to_coordinates(df), 3, df)) == vectors(df)


def test_vectors_from_entries(spark):
    """Linear in entries and width; entries beyond the width go, two at a place are an error."""
    entries = spark.createDataFrame([(1, 2, 5.0), (1, 0, 4.0), (2, 3, 1.0), (2, 9, 7.0), (3, -1, 2.0)], "cell_id bigint, pos int, value double")
    assert vectors(matrix.to_vectors(entries, 4)) == {1: [4, 0, 5, 0], 2: [0, 0, 0, 1]}
    assert vectors(matrix.to_vectors(entries, 4, spark.range(1, 4).toDF("cell_id")))[3] == [0, 0, 0, 0]
    with pytest.raises(Exception, match="two entries at one place of cell 1"):
        matrix.to_vectors(entries.union(entries.limit(1)), 4).collect()
    many = spark.range(400).select(F.col("id").alias("cell_id"), F.posexplode(F.expr("transform(sequence(0, 1999), p -> double((p + id) % 2))")).alias("pos", "value")).filter("value <> 0")
    took = time.time()
    assert matrix.to_vectors(many, 2000).agg(F.sum(F.size("x"))).first()[0] == 800_000
    assert matrix.to_vectors(many, 2000).agg(F.sum(V.total("x"))).first()[0] == 400_000
    assert time.time() - took < 20  # a search for each place took minutes


def test_products_of_many_features(spark):
    x = np.random.default_rng(2).standard_normal((50, 150))
    assert np.abs(project.gram(cells(spark, x.tolist()), 150) - x.T @ x).max() < 1e-9
    with pytest.raises(ValueError, match="more than the driver holds"):
        project.gram(cells(spark, [[1]]), project.MOST_FEATURES + 1)


def test_first_and_last_names(spark):
    d = spark.createDataFrame([(0, "e1", "a"), (1, "e2", "b"), (2, "e3", "a"), (3, "e2", "c")], "line_no int, feature_id string, feature_name string")
    assert {(r["feature_name"], r["feature_id"]) for r in harmonise.first_names(d).collect()} == {("a", "e1"), ("b", "e2"), ("c", "e2")}
    assert {(r["feature_id"], r["feature_name"]) for r in harmonise.last_names(d).collect()} == {("e1", "a"), ("e2", "c"), ("e3", "a")}


def test_alignment_sums_falls_back_and_fills(spark):
    names = spark.createDataFrame([("a", "id"), ("b", "id")], "feature_name string, feature_id string")
    source = spark.createDataFrame([("a", 0), ("b", 1), ("own", 2), ("lost", 3)], "feature_name string, pos int")
    order = spark.createDataFrame([("id", 0), ("own", 1), ("absent", 2)], "feature_id string, pos int")
    df = cells(spark, [[1, 1, 1, 1], [0, 0, 0, 0]])
    entries = harmonise.align(matrix.to_coordinates(df), source, names, order)
    full = harmonise.filled(entries, df, harmonise.absent(source, names, order))
    assert vectors(matrix.to_vectors(full, 3, df)) == {0: [2, 1, 0.5], 1: [0, 0, 0.5]}


def test_misordered_features_give_two_divergences(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "feature_id string, pos int")
    b = spark.createDataFrame([("y", 0), ("x", 1), ("z", 2)], "feature_id string, pos int")
    assert harmonise.divergences(a, b).count() == 2
    harmonise.require_same_order(a, a)
    with pytest.raises(ValueError, match="features differ"):
        harmonise.require_same_order(a, b)


def test_coverage_of_nothing(spark):
    empty = spark.createDataFrame([], "feature_name string, feature_id string, in_second boolean, without_id boolean")
    row = harmonise.coverage_summary(empty).first()
    assert row["features"] == 0 and row["present_percent"] is None


def test_tied_top_n(spark):
    frequency = spark.createDataFrame([(2, 5.0), (0, 5.0), (1, 5.0)], "pos int, frequency double")
    assert [r["pos"] for r in select.top_features(frequency, 2).orderBy("rank").collect()] == [0, 1]


def test_sample_ignores_partitions(spark):
    df = cells(spark, [[i] for i in range(50)])
    pick = lambda d: [r["cell_id"] for r in select.sample_of(d, 7, 1).collect()]
    assert pick(df) == pick(df.repartition(9)) and len(pick(df)) == 7


def test_nearest_three_queries(spark):
    df = cells(spark, [[0, 0], [1, 0], [0, 3], [5, 5]])
    ids = lambda q, k=2, p=2.0: [r["cell_id"] for r in neighbours.nearest(df, neighbours.query_vector(df, q, 2), k, p).orderBy("rank").collect()]
    assert ids([0.0, 0.0]) == [0, 1]
    assert ids([[0.0, 2.0], [0.0, 4.0]]) == [2, 0]
    assert ids([0, 1], 1) == [0]  # the mean of cells 0 and 1 is as near to both: the lower id
    assert ids([0.0, 0.0], 3, 0.5) == [0, 1, 2]


def test_element_and_order(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(1.0), F.lit(3.0)).alias("x")).select(V.element("x", "SECOND").alias("s"), V.element("x", 0).alias("l"), V.argsort("x").alias("a"), V.argsort("x", True).alias("d"), V.element("x", 9).alias("n")).first()
    assert (row["s"], row["l"], row["a"], row["d"], row["n"]) == (1.0, 3.0, [1, 0, 2], [2, 0, 1], None)
    with pytest.raises(ValueError):
        V.element("x", "THIRD")


def test_bipolar_threshold_and_hamming(spark):
    x, y = F.array(*map(F.lit, [0.0, 0.5, 1.0])), F.array(*map(F.lit, [0.0, 1.0, 1.0]))
    none = F.array().cast("array<double>")
    row = spark.range(1).select(V.bipolar(x).alias("b"), V.over(x, 0.5).alias("o"), V.hamming(x, y).alias("h"), V.hamming(none, none).alias("n"), V.half_added(x, y).alias("a")).first()
    assert row["b"] == [-1, 0, 1] and row["o"] == [0, 0, 1] and row["h"] == pytest.approx(1 / 3) and row["n"] is None and row["a"] == [0, 1, 1.5]


def test_softmax_does_not_overflow(spark):
    got = spark.range(1).select(F.array(F.lit(40000.0), F.lit(39999.0)).alias("s")).select(V.softmax("s", 1.0).alias("w")).first()["w"]
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e)])


def test_basis_and_components(spark):
    basis = project.orthonormal_basis(30, 6)
    assert project.orthogonality_error(project.basis_table(spark, basis)).first()["error"] < 1e-9
    x = np.random.default_rng(0).standard_normal((40, 5))
    df = cells(spark, x.tolist())
    loadings, values = project.uncentred_components(df, 5)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    assert values == pytest.approx(s) and np.abs((loadings * v.T).sum(axis=0)) == pytest.approx(np.ones(5))
    with pytest.raises(ValueError):
        project.project(df, None)


def profile(spark, rows, classes):
    return spark.createDataFrame([(i, c, [float(v) for v in r]) for i, (r, c) in enumerate(zip(rows, classes, strict=True))], "pattern_id int, cls int, p array<double>")


def test_stored_patterns_come_back(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (6, 40)).tolist()
    found = memory.Memory(profile(spark, rows, range(6))).recall(cells(spark, rows))
    assert vectors(found) == {i: r for i, r in enumerate(rows)}


def test_recall_of_ties_zero_steps_and_nothing(spark):
    patterns = profile(spark, [[1, 1, 0, 0], [1, 0, 1, 0]], [1, 2])
    query = cells(spark, [[1, 0, 0, 0]])
    assert vectors(memory.Memory(patterns).recall(query)) == {0: [1, 0, 0, 0]}
    assert vectors(memory.Memory(patterns, memory.Settings(steps=0, threshold=0.5)).recall(query)) == {0: [1, 0, 0, 0]}
    with pytest.raises(ValueError, match="empty"):
        memory.Memory(patterns.limit(0)).recall(query)


def test_absent_features_are_neutral(spark):
    patterns = profile(spark, [[1, 1, 0, 0], [0, 1, 1, 1]], [1, 2])
    df = cells(spark, [[1, 0, 0, 1], [0, 0, 0, 0]])
    absent = spark.createDataFrame([(1,)], "pos int")
    got = {(r["cell_id"], r["pattern_id"]): r["score"] for r in memory.bit_scores(matrix.to_coordinates(df), df, patterns, absent).collect()}
    for c, x in vectors(df).items():
        x = [0.5 if i == 1 else v for i, v in enumerate(x)]
        for k, p in enumerate([[1, 1, 0, 0], [0, 1, 1, 1]]):
            assert got[c, k] == sum((2 * a - 1) * (2 * b - 1) for a, b in zip(x, p, strict=True))


def test_two_centroids_one_cell_and_skipped_class(spark):
    rows = [[0, 0], [10, 0], [5, 0]]
    centres = {1: np.array([[4.0, 0.0], [6.0, 0.0]])}
    chosen = cluster.nearest_in_class(cells(spark, rows), centres, 1)
    assert [r["cell_id"] for r in chosen.collect()] == [2, 2]
    protos = cluster.prototypes(cells(spark, rows, [3, 3, 1]), {"default": 1, 3: 2}, 1, classes=[7, 3, 1]).orderBy("pattern_id").collect()
    assert [r["cls"] for r in protos] == [3, 3, 1]


def test_prototypes_ignore_partitions(spark):
    rng = np.random.default_rng(1)
    df = cells(spark, rng.integers(0, 2, (60, 12)).tolist(), rng.integers(1, 4, 60).tolist())
    show = lambda d: [tuple(r) for r in cluster.prototypes(d, 3, 3).orderBy("pattern_id").collect()]
    assert show(df) == show(df.repartition(7))


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 2, 4), (2, 2, 0, 4), (3, 2, 1, 4)], "label int, predicted int, mismatches bigint, width int")
    got = evaluate.metrics(rows).first()
    assert got["accuracy"] == 0.5 and got["exact_rate"] == 0.5 and got["similarity"] == pytest.approx(1 - 3 / 16)
    assert got["f1_macro"] == pytest.approx((2 / 3 + 0.5 + 0) / 3) and got["f1_weighted"] == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    report = {r["name"]: r for r in evaluate.report(rows, [1, 2, 9]).collect()}
    assert report["9"]["support"] == 0 and report["9"]["f1"] == 0
    assert sum(r["n"] for r in evaluate.confusion(rows, [1, 2, 3]).collect()) == 4


def test_best_is_first_of_equals(spark):
    rows = spark.createDataFrame([(0, 0.50001), (1, 0.50004), (2, 0.4)], "config int, accuracy double")
    assert sweep.best(rows).first()["config"] == 0


def test_labels_and_keys(spark):
    df = spark.createDataFrame([("Ast", "a.1"), ("odd", "b.2")], "celltype string, key string")
    coded = prepare.encode_labels(df, "celltype", prepare.SHORT_CODES)
    assert [r["label"] for r in coded.collect()] == [1, None]
    assert [r["key"] for r in df.select(prepare.normal_key("key").alias("key")).collect()] == ["a-1", "b-2"]
    assert [r["name"] for r in prepare.name_labels(coded, prepare.SHORT_CODES).collect()] == ["Ast", None]
    assert sorted(prepare.LONG_CODES.values()) == list(range(1, 19))
    assert prepare.coded_only(coded).count() == 1
    assert prepare.repeated_keys(df.union(df), "key").count() == 2
