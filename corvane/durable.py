"""Intermediate tables that outlive the executors which wrote them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_staged: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("_scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session whose master is this one machine may lack the setting; it
    then gets a temporary folder that is removed at exit.
    """
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if set_dir := spark.sparkContext.getCheckpointDir():
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def _path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    scope = _scope.get()
    (_staged if scope is None else scope).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as a table and read back: computed once, with its lineage cut."""
    path = _path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A staged table that parts are appended to; what is read holds the parts appended before."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, _path(spark, name)

    def append(self, df: DataFrame) -> DataFrame:
        """Append ``df``; the table with it."""
        df.write.option("compression", "zstd").mode("append").parquet(self.path)
        return self.spark.read.schema(df.schema).parquet(self.path)


def _remove(spark: SparkSession, paths: list[str]) -> int:
    n = len(paths)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(configuration).delete(path, True)
    return n


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside once the block ends; what it returns must be collected or written by then."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        _remove(spark, paths)


def discard(spark: SparkSession) -> int:
    """Remove the tables that this process has staged outside ``staging``, once nothing reads them any more; how many there were."""
    return _remove(spark, _staged)
