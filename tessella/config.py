"""Where a workflow finds its inputs and keeps its tables, and its settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from .operators.memory import Settings
from .sources import store


@dataclass(frozen=True)
class Inputs:
    """Where the inputs of a run lie: two matrices with their dictionaries, labels, and what other programs have made."""

    first_matrix: str
    second_matrix: str
    first_dictionary: str
    second_dictionary: str
    first_labels: str
    second_labels: str
    top_features: str | None = None
    projection: str | None = None

    def missing(self, spark: SparkSession) -> list[str]:
        """Those of the inputs that aren't there."""
        return store.missing(spark, [p for p in asdict(self).values() if p is not None])


@dataclass(frozen=True)
class Paths:
    """Folders of a run's tables below one root."""

    root: str

    def of(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def binarised(self) -> str:
        return self.of("binarised")

    @property
    def aligned(self) -> str:
        return self.of("aligned")

    @property
    def top_features(self) -> str:
        return self.of("top_features")

    @property
    def training(self) -> str:
        return self.of("training")

    @property
    def memory(self) -> str:
        return self.of("memory")


@dataclass(frozen=True)
class Workflow:
    """Settings of a whole run; the recall's threshold lies in bipolar space."""

    features: int = 5000
    components: int = 600
    seed: int = 42
    classes: tuple[int, ...] = (1, 3, 4, 5, 6, 7)
    clusters: int | dict[int, int] = 10
    nearest: int = 1
    steps: int = 3
    recall: Settings = field(default_factory=lambda: Settings(beta=8.0, steps=1, threshold=0.5))
