"""The whole workflow on two small data sets with a known answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Inputs, Paths, Workflow
from tessella.operators import cluster, memory, prepare
from tessella.plans import workflow
from tessella.sources.dataset import DataSet, read_dataset, read_features, read_table


def data_set(spark, names, rows, labels, first_id=0):
    cells = spark.createDataFrame([(first_id + i, l) for i, l in enumerate(labels)], "cell_id bigint, label int")
    features = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature_name string, pos int")
    entries = [(first_id + i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    return DataSet(cells, features, spark.createDataFrame(entries, "cell_id bigint, pos int, value double"))


def test_two_data_sets(spark, tmp_path):
    rng = np.random.default_rng(8)
    base = {c: rng.integers(0, 2, 40) for c in (1, 3)}
    labels = [1, 3] * 20
    noisy = lambda: np.stack([np.where(rng.random(40) < 0.05, 1 - base[c], base[c]) * 3.0 for c in labels])
    first = data_set(spark, [f"g{i}" for i in range(40)], noisy(), labels)
    # The second lacks the last eight features, names its own in another order, and has one more.
    order = rng.permutation(32)
    second = data_set(spark, [f"g{i}" for i in order] + ["other"], np.column_stack([noisy()[:, order], np.ones(40)]), labels, 1000)
    ids = spark.createDataFrame([(i, f"id{i}", f"g{i}") for i in range(40)], "line_no int, feature_id string, feature_name string")
    settings = Workflow(features=30, components=10, classes=(1, 3), clusters=2)
    aligned = workflow.align_pair(first, second, ids, ids.filter("line_no < 32"))
    assert aligned.lacking.count() == 8 and aligned.tracking.count() == 8
    aligned.write(str(tmp_path / "aligned"))
    filled = spark.read.parquet(str(tmp_path / "aligned/filled")).collect()
    assert {(r["feature_id"], r["filled"], r["tracked"]) for r in filled} == {(f"id{i}", 0.5, True) for i in range(32, 40)}
    # A feature that the dictionary has and the matrix lacks is filled, too, but not tracked.
    fewer = workflow.align_pair(first, DataSet(second.cells, second.features.filter("feature_name <> 'g3'"), second.entries), ids, ids.filter("line_no < 32"))
    assert {r["feature_id"] for r in fewer.filled.filter("not tracked").collect()} == {"id3"} and fewer.tracking.count() == 8
    top = workflow.chosen_features(aligned, settings.features)
    held, width = workflow.train(first.cells, aligned.first, top, settings)
    assert width == 30 and len(held.patterns) == 4
    held.save(spark, Paths(str(tmp_path)).memory)
    again = memory.load(spark, Paths(str(tmp_path)).memory)
    assert again.settings == settings.recall
    judged, scores = workflow.recall_and_score(again, second.cells, aligned.second, top, width, aligned.lacking, settings)
    assert judged.count() == 40 and scores.first()["accuracy"] == 1.0


def test_data_set_round_trip(spark, tmp_path):
    d = data_set(spark, ["a", "b"], [[1, 0], [2, 3]], [1, 2])
    d.write(str(tmp_path / "d"))
    back = read_dataset(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.entries.collect())) == sorted(map(tuple, d.entries.collect()))
    assert read_features(spark, str(tmp_path / "d")).count() == 2
    (tmp_path / "t.csv").write_text("k,v\n1,x\n")
    assert read_table(spark, str(tmp_path / "t.csv"), "k int, v string").first()["v"] == "x"


def test_keys_must_match(spark):
    cells = spark.createDataFrame([(0, 1), (1, 2)], "cell_id bigint, label int")
    other = spark.createDataFrame([(0, "a"), (1, "b")], "cell_id bigint, name string")
    assert prepare.keyed_together(cells, other).count() == 2
    with pytest.raises(ValueError, match="1 cells are missing"):
        prepare.keyed_together(cells, other.filter("cell_id = 0"))


def test_restarts_find_the_clusters(spark):
    rows = [(i, [float(10 * (i % 3)), float(i % 2)]) for i in range(60)]
    cells = spark.createDataFrame(rows, "cell_id bigint, x array<double>")
    centres, cost = cluster.with_restarts(cells, 3, 4, 5)
    assert sorted(round(c[0]) for c in centres) == [0, 10, 20] and cost == pytest.approx(15.0)
    assert cluster.with_restarts(cells.repartition(5), 3, 4, 5)[1] == cost
    assert F is not None


def test_paths_and_missing_inputs(spark, tmp_path):
    (tmp_path / "there").write_text("")
    there, gone = str(tmp_path / "there"), str(tmp_path / "gone")
    assert Inputs(there, there, there, gone, there, there, projection=gone).missing(spark) == [gone, gone]
    paths = Paths("/r/")
    assert [paths.binarised, paths.aligned, paths.top_features, paths.training, paths.memory] == [f"/r/{n}" for n in ("binarised", "aligned", "top_features", "training", "memory")]
