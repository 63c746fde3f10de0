"""Frames that several parts of a report read, written once into the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master local (tests), a temporary folder that goes at exit."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="sweetframe-cohort-")
        atexit.register(shutil.rmtree, _local[app], True)
    return _local[app]


def _delete(spark: SparkSession, path: str, at_exit: bool) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if at_exit:
        system.deleteOnExit(where)
    else:
        system.delete(where, True)


def written(df: DataFrame, *sort: str) -> DataFrame:
    """df as a table of its own: what made it runs once, however often it is read, and isn't run again if executors are lost.

    sort: columns that each file is sorted by, so that its row groups can be skipped. The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/sweetframe-cohort-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    _delete(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage(spark: SparkSession) -> Iterator[list[str]]:
    """For loops: paths appended to the list go at the end of the block, whether or not it succeeded."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        for path in paths:
            _delete(spark, path, at_exit=False)


def round_of(df: DataFrame, paths: list[str]) -> DataFrame:
    """df, written as one round of a loop within ``stage``."""
    spark = df.sparkSession
    path = f"{folder(spark)}/sweetframe-cohort-{uuid.uuid4().hex}"
    paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
