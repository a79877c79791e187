"""The physical plans that scale depends on."""

from tessella.operators import cluster, memory, select, sweep
from tessella.plans import catalogue
from tessella.plans import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_needed_columns_and_filter(spark):
    text = plan(catalogue.feature_frequency_topn(spark, SF))
    assert "struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in text
    assert "TakeOrderedAndProject" in text and "partial_sum" in text
    assert "PushedFilters: [IsNotNull(label), Not(EqualTo(label,0))" in plan(T.cells(spark, SF).filter("label <> 0"))


def test_a_class_sends_few_rows(spark):
    assert "WindowGroupLimit" in plan(cluster.first_centres(T.bits(spark, SF), 3))


def test_alignment_has_one_shuffle(spark):
    assert plan(catalogue.align_sum_duplicates(spark, SF)).count("Exchange hashpartitioning(cell_id") == 1


def test_sampling_takes_rows_in_each_task(spark):
    assert "TakeOrderedAndProject" in plan(select.sample_of(T.cells(spark, SF), 5, 1))


def test_relational_queries_stay_in_the_jvm(spark):
    for name in ("binarize_counts", "align_with_fill", "tracking", "coverage", "scores_with_absent", "projection_entries", "knn_l2"):
        assert not any(x in plan(catalogue.QUERIES[name](spark, SF)) for x in ("Python", "Arrow"))


def test_fill_takes_every_cell(spark):
    cells = {r["cell_id"] for r in T.cells(spark, SF).select("cell_id").collect()}
    for name in ("recall_with_fill", "scores_with_absent"):
        assert {r["cell_id"] for r in catalogue.QUERIES[name](spark, SF).select("cell_id").collect()} == cells
    absent = [r for r in catalogue.QUERIES["align_with_fill"](spark, SF).collect() if r["pos"] % 5 == 2]
    assert absent and all(r["entries"] == len(cells) for r in absent)


def test_sums_of_every_feature(spark):
    assert {r["feature_id"] for r in catalogue.QUERIES["unpivot_sums"](spark, SF).collect()} == {f"f{i}" for i in range(T.WIDTH)}


def passes(spark, monkeypatch, run):
    """How often the cells are read by Python kernels."""
    seen = []
    kind = type(spark.range(0))
    before = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: seen.append(self.columns) or before(self, *a, **b))
    run()
    return sum("x" in c and "key" not in c for c in seen)


def test_a_pass_serves_all_starts_and_configurations(spark, monkeypatch):
    cells = T.bits(spark, SF)
    assert passes(spark, monkeypatch, lambda: cluster.with_restarts(cells, 4, 10, 5)) == 5 + 1  # steps, and the costs
    configs = [(2, 1), (3, 1), (3, 3), ({1: 4, "default": 2}, 5)]
    assert passes(spark, monkeypatch, lambda: sweep.sweep_prototypes(cells, cells, configs, memory.Settings()).collect()) == 3 + 1 + 1  # steps, nearest cells, judging
