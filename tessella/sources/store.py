"""Tables in folders that all executors share, and publication that never shows half a table."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where none is set, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends in good order."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    system.mkdirs(where)  # what isn't there can't be registered
    system.deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def missing(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """Those of the expected outputs that aren't there."""
    return [p for p in paths if not exists(spark, p)]


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a published table, in the order of their names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(where):
        return []
    found = sorted(f"{path}/{s.getPath().getName()}" for s in system.listStatus(where))
    return [p for p in found if exists(spark, f"{p}/_SUCCESS")]


def published(spark: SparkSession, folder: str, name: str, settings: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made under these settings: read if it was published before, else made and published.

    The settings are part of the path, so other settings never read a stale table. Each write has a folder of its own, and one
    that Spark hasn't marked as finished isn't read: what a writer that died left behind, or one that is still at work, is never
    seen, and nothing that a reader may have open is overwritten. Two writers at once publish the same table twice; any
    finished version will do.
    """
    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{key}"
    if not versions(spark, path):
        make().write.parquet(f"{path}/{uuid.uuid4().hex}")
    return spark.read.parquet(versions(spark, path)[0])
