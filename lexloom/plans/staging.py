"""Tables written to the shared folder, to cut lineage and to share a result among plans.

Operators that stage start jobs when they are called. Their tables live under one folder of the application, which goes when
the driver's interpreter ends; `scope` deletes what was staged inside it as soon as it is left.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[tuple[SparkSession, str]]] = []
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the place that driver and executors share.

    A folder of our own stands in only where driver and executors are one machine; a cluster must name its shared folder.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file:///tmp/checkpoints"
    path = f"{configured.rstrip('/')}/lexloom-{context.applicationId}"
    if path not in _folders:
        _folders[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _forget() -> None:
    for path, spark in _folders.items():
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # the JVM may be gone before the interpreter
            pass


@contextmanager
def scope() -> Iterator[None]:
    """Delete on exit what was staged inside; results that read it must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._staged_path)
