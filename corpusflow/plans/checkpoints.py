"""Cutting lineage and writing intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: there the driver
    and the executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        current = spark.sparkContext.getCheckpointDir()
        if current is not None:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="corpusflow-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list = []


@atexit.register
def _remove_scratch() -> None:
    """Intermediate tables of this process go when it ends; the session may be gone by then."""
    for system, path in _made:
        try:
            system.delete(path, True)
        except Exception:  # nothing can be done about it here
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, as a URI of its file system.

    A folder without scheme lies in the default file system, for Spark as for files that
    tasks write themselves. What is written there is removed when the process ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/corpusflow/{name}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    _made.append((system, path))
    whole = system.makeQualified(path).toString()
    return "file://" + whole[len("file:"):] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet and read back, for results that are used many times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
