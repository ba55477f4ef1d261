"""The folder that driver and executors share, and tables cut off from their lineage there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
#: The list that takes the paths of the tables that ``cut`` writes while a ``noted`` block runs.
_notes: ContextVar[list[str] | None] = ContextVar("notes", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is configured and Spark runs in one process (tests)."""
    global _own_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it must be one that driver and executors share")
        if _own_dir is None:
            _own_dir = "file://" + tempfile.mkdtemp(prefix="fluora-")
        path = _own_dir
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes a small table once, in the shared folder; its files stay unless spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Writes a table as Parquet, with the writer's options, to the shared folder and reads it back, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/fluora-{uuid.uuid4().hex}"
    if (paths := _notes.get()) is not None:
        paths.append(path)
    df.write.parquet(path, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noted(paths: list[str]) -> Iterator[list[str]]:
    """Within the block, ``paths`` takes the paths of the tables that ``cut`` writes, and no table of anything else."""
    before = _notes.set(paths)
    try:
        yield paths
    finally:
        _notes.reset(before)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that ``cut`` has written, and empties the list: for callers that have read them for the last time."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
