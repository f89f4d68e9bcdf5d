"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes a finished job's shuffle files at once instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []
#: Paths written within each open scratch(), the innermost last.
_open: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        _remove(spark, path)


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster: spark.checkpoint.dir. Where it is unset, a temporary folder if driver and executors
    are one process, and else an error: executors don't see each other's folders."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.conf.set("spark.checkpoint.dir", base)
        _made.append((spark, base))
    return base


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are removed at the end; what is returned from within must be stored with keep=1, from within two with keep=2."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs within; the user's own is put back."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stored(df: DataFrame, name: str = "", keep: int = 0) -> DataFrame:
    """df, written as a table in the shared folder and read back: its lineage ends there, and lost executors lose nothing.
    keep: how many of the open scopes it outlives."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name or 'stored-' + uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    scopes = _open[: max(0, len(_open) - int(keep))]
    if scopes:
        scopes[-1].append(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
