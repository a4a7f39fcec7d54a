"""Shared storage for intermediate tables: written once, read again, and removed when nothing reads them any more."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without one, a temporary folder is set.

    On a cluster the setting is required: a machine-local folder would be
    invisible to the other executors.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="codeloom-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{at}")
    spark.sparkContext.setCheckpointDir(f"file://{at}")
    return f"file://{at}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it to lie on."""
    files, at = _file_system(spark, path)
    return files.makeQualified(at).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage (a lost executor costs a re-read, not a recomputation) and
    gives the planner the real size, so that it broadcasts only what is small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes that the planner takes ``df`` for: of a table just written, those of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables written within it at its end, but for those taken off the list that it yields."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]
        for path in made:
            remove(spark, path)
