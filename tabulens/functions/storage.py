"""Where intermediate tables live, and until when."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"

#: Folders made in each open scope, the innermost last.
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, as named in ``spark.checkpoint.dir``.

    Only a local session may do without the setting: it uses a folder of its own
    below the session's warehouse, named after the application.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(f"{warehouse}/tabulens-{context.applicationId}")
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; the innermost open scope removes it."""
    folder = f"{shared_folder(spark)}/tabulens/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``new_folder`` named, if it was written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the intermediate folders made inside it when it ends; nothing may read them any more."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        for folder in made:
            remove(spark, folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and scan that copy from now on."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
