"""Intermediate results as Parquet tables in the folder that driver and executors share, so that what follows starts from them.

A table outlives lost executors and keeps the plans made from it small; what reads it still prunes columns and pushes filters.
Tables go when they are dropped, all others when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="fieldweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fieldweave/{uuid.uuid4().hex}/{name}"


def _path(spark: SparkSession, name: str):
    """The path, and the file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Whether Spark deletes the shuffle files of a job when the job ends, instead of when the driver happens to collect garbage.
CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, read again. Its shuffle files go at once; the session's settings stay as they are."""
    spark, path = df.sparkSession, new_dir(df.sparkSession, name)
    before = {key: spark.conf.get(key, None) for key in CLEANUP}
    for key in CLEANUP:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what new_dir() made deleted when the driver ends."""
    at, system = _path(spark, path)
    system.deleteOnExit(at.getParent())


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, for what is read more than once or has a long plan."""
    return written(df, "settled")


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        at, system = _path(spark, file)
        system.delete(at.getParent().getParent(), True)


class Scratch:
    """Tables written on the way to a result, to be deleted together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(written(df, name))
        return self.tables[-1]

    def cleared(self, *keep: DataFrame) -> None:
        """Delete all but those to keep."""
        for table in self.tables:
            if not any(table is x for x in keep):
                dropped(self.spark, table)
        self.tables = list(keep)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; else Spark joins it as it does any other."""
    return F.broadcast(df) if df.count() <= rows else df
