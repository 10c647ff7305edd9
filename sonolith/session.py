"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, qualified by the default file system.

    Where it is unset a folder in the warehouse is used, on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sonolith"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # Hadoop writes file:/x where other libraries want file:///x
    return ("file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole).rstrip("/")


#: Folders named by scratch() within each open scratch_scope(), innermost last.
_SCOPES: list[list[str]] = []


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sonolith-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at its end what operators wrote in the shared folder meanwhile, but for tables of materialize() that are handed
    to the function it gives. What is read inside must be materialized there."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._scratch)
        return df

    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(kept)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote in the shared folder, results of operators that are still unread too."""
    _delete(spark, _home(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again. Lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of materialize() that nothing will read any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)
