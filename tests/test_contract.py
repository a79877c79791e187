"""The driver's contract: names and columns agree, and the library stands without the operators on documents."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb

import __spark_entry__ as contract

ROOT = Path(__file__).parents[1]
SF = Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_same_columns_as_the_oracles(spark):
    """By plans alone; rows are compared in test_parity and by the driver."""
    duck = duckdb.connect()
    for path in SF.glob("*.parquet"):
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    for name in ("recall_metrics", "align_with_fill", "sweep_k", "uncentered_pca", "kmeans_clusters", "tracking"):
        expected = duck.sql(contract.oracle_sql()[name]).columns
        assert sorted(contract.queries()[name](spark, str(SF)).columns) == sorted(expected)


def test_library_stands_alone(tmp_path):
    """Without the operators on documents and their pipeline the entry imports and the other queries are there."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    queries, oracles = map(int, said.stdout.split())
    from jobs import registry
    from tessella.plans import catalogue

    assert (queries, oracles) == (len(catalogue.QUERIES) + len(registry.QUERIES), len(catalogue.ORACLES) + len(registry.ORACLES))


def test_nothing_else_imports_the_operators_on_documents():
    for path in [*(ROOT / "tessella").rglob("*.py"), *(ROOT / "jobs").rglob("*.py")]:
        if "llm" not in path.parts:
            text = path.read_text()
            assert "corpus_pipeline" not in text and "tessella.llm" not in text and "from .llm" not in text and "from ..llm" not in text, path
