"""What all operators of this subpackage use: tables on the way (sinks.lineage), bounded Arrow batches, columns set aside."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.lineage import Scratch, bounded, dropped, new_dir, shared_dir, until_exit, written

__all__ = [
    "Scratch", "arrow_map", "bounded", "documents", "dropped", "new_dir", "release_memory", "set_aside", "shared_dir", "small_batches", "until_exit", "written",
]


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what gives a frame made from it df's columns and their names again."""
    taken, renamed = {*df.columns, *names}, {}
    for name in names:
        if name in df.columns:
            new = next(x for i in range(len(taken) + 1) if (x := f"_{name}_{i}") not in taken)
            renamed[name] = new
            taken.add(new)
    own = [(c, renamed.get(c, c)) for c in df.columns]
    return df.withColumnsRenamed(renamed), lambda made: made.select(*(F.col(f"`{new}`").alias(c) for c, new in own))


def release_memory() -> None:
    """Give freed memory of this Python worker back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with freed memory given back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(task, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of text that a Python worker gets, by rows and by bytes: the same for all operators of this subpackage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
