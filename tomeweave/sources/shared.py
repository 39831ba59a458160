"""Tables that are derived once in a session and read by many queries, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_built: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (one machine only) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tomeweave-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        path, fs = _path(spark, name)
        fs.delete(path, True)


def _state(spark: SparkSession, name: str) -> str:
    """What tells whether an input has changed: number and bytes of its files, and when it was written."""
    path, fs = _path(spark, name)
    found = fs.getContentSummary(path)
    return f"{found.getFileCount()}-{found.getLength()}-{fs.getFileStatus(path).getModificationTime()}"


def built(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name derived from a source path: written at the first call and whenever the source has changed, else read."""
    key = (spark.sparkContext.applicationId, name, source, _state(spark, source))
    if key not in _built:
        path = f"{shared_dir(spark)}/tomeweave/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        atexit.register(_remove, spark, path)
        _built[key] = path
    return spark.read.parquet(_built[key])
