"""Tables written to the shared folder of the cluster, to cut lineage between rounds.

A written table survives the loss of an executor, is computed once however many
later steps read it, and gives the optimizer its true size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_scratch: ContextVar[str] = ContextVar("scratch", default="")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session with neither gets a folder of its own; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="mentionlake-")
        atexit.register(shutil.rmtree, _own_folders[app], ignore_errors=True)
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/mentionlake/{app}/{_scratch.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end; for work whose results are written
    before it, as a micro-batch's are."""
    before = _scratch.get()
    mark = _scratch.set(f"{before}scratch-{uuid.uuid4().hex}/")
    folder = f"{shared_folder(spark)}/mentionlake/{spark.sparkContext.applicationId}/{_scratch.get()}"
    try:
        yield
    finally:
        _scratch.reset(mark)
        delete(spark, folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_counted(
    df: DataFrame, name: str, what: Column | None = None, path: str | None = None
) -> tuple[DataFrame, int]:
    """As ``stage``, with the number of rows (of non-null ``what``) of the written table."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table, (table if what is None else table.filter(what.isNotNull())).count()


def release(spark: SparkSession) -> None:
    """Delete what this application staged; call it when its results are written."""
    delete(spark, f"{shared_folder(spark)}/mentionlake/{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete ``folder`` and all below it, if it exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
