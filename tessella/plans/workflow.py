"""The whole way: two data sets onto one dictionary, a memory trained on the first, the second recalled and scored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Workflow
from ..operators import cluster, evaluate, harmonise, matrix, prepare, project, select
from ..operators.memory import Memory
from ..operators.neighbours import Patterns, gathered
from ..sources.dataset import DataSet


@dataclass(frozen=True)
class Aligned:
    """Both data sets' binary entries at canonical positions, the order, and what the second one lacks.

    tracking lists the features that the second dictionary lacks, filled those that its matrix lacks, whether tracked or not.
    """

    order: DataFrame
    first: DataFrame
    second: DataFrame
    lacking: DataFrame
    tracking: DataFrame

    @property
    def filled(self) -> DataFrame:
        """feature_id, pos, filled (the value) and tracked of all features that are filled in the second data set."""
        told = self.tracking.select("feature_id", F.lit(True).alias("tracked")).distinct()
        return self.lacking.select("feature_id", "pos", F.lit(harmonise.ABSENT).alias("filled")).join(told, "feature_id", "left").fillna(False, ["tracked"])

    def write(self, path: str, mode: str = "error") -> None:
        """Every table below path."""
        for name in ("order", "first", "second", "filled", "tracking"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")


def align_pair(first: DataSet, second: DataSet, first_dictionary: DataFrame, second_dictionary: DataFrame) -> Aligned:
    """The first data set's features set the order. Nothing is computed yet but plans; the fill of one half is never formed."""
    names, others = harmonise.first_names(first_dictionary), harmonise.first_names(second_dictionary)
    order = harmonise.canonical_order(first.features, names)
    move = lambda d, n: harmonise.align(prepare.binarise_entries(d.entries), d.features, n, order)
    lacking = harmonise.absent(second.features, others, order)
    return Aligned(order, move(first, names), move(second, others), lacking, harmonise.tracking(names, others, order))


def chosen_features(aligned: Aligned, n: int) -> DataFrame:
    """The n features most frequent in the first data set."""
    return select.top_features(select.feature_frequency(aligned.first, aligned.order), n)


def train(cells: DataFrame, entries: DataFrame, top: DataFrame, settings: Workflow) -> tuple[Memory, int]:
    """A memory of prototypes, and the number of features. cells: cell_id and label.

    Cells are clustered in a projection on a seeded basis; prototypes are taken from the bits themselves.
    """
    width = top.count()  # at most settings.features rows
    bits = labelled_vectors(cells, entries, top, width)
    basis = project.orthonormal_basis(width, min(settings.components, width), settings.seed)
    space = project.project(bits.select("cell_id", "x"), basis)
    patterns = cluster.prototypes(bits, settings.clusters, settings.nearest, settings.steps, settings.classes, space)
    return Memory(gathered(patterns), settings.recall), width


def labelled_vectors(cells: DataFrame, entries: DataFrame, top: DataFrame, width: int, lacking: DataFrame | None = None) -> DataFrame:
    """cell_id, label and x over the chosen features, one half where the data set lacks a feature."""
    x = matrix.to_vectors(select.keep_features(entries, top), width, cells)
    if lacking is not None:
        places = top.select("pos").join(lacking.select("pos", F.lit(True).alias("lacks")), "pos", "left").orderBy("pos")
        mask = F.array(*(F.lit(bool(r["lacks"])) for r in places.collect()))  # a flag for each chosen feature
        x = x.withColumn("x", F.zip_with("x", mask, lambda v, m: F.when(m, harmonise.ABSENT).otherwise(v)))
    return cells.select("cell_id", "label").join(x, "cell_id")


def recall_and_score(memory: Memory, cells: DataFrame, entries: DataFrame, top: DataFrame, width: int, lacking: DataFrame, settings: Workflow) -> tuple[DataFrame, DataFrame]:
    """Judged cells, and the metrics over the classes of the settings."""
    vectors = labelled_vectors(cells, entries, top, width, lacking)
    judged = evaluate.judged(memory.recall(vectors), memory.patterns if isinstance(memory.patterns, Patterns) else gathered(memory.patterns))
    return judged, evaluate.metrics(judged, settings.classes)
