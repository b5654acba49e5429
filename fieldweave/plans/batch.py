"""Work on many keys, such as the clips of a game, of which one that fails doesn't stop the others, and which goes on where it stopped.

Keys are worked on in waves. A wave's rows are a folder of their own; the status that names it is written after it, so a
crash between leaves a folder that nothing reads. A wave that fails is halved until the key that fails is alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import joined
from ..sinks.lineage import Scratch, settled

Names = Sequence[str]
CACHED, CREATED, FAILED = "cached", "created", "failed"


def captured(df: DataFrame, keys: Names, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, errors: tuple[type[Exception], ...] = (Exception,)) -> DataFrame:
    """run over the rows of each key: its rows with a null `error`, or one row with the keys and the text of the error that it raised.

    Columns of schema that are no keys are null in a row of an error.
    """
    names = [x.strip().split()[0].strip("`") for x in schema.split(",")]
    own = [k for k in keys if k in names]

    def attempt(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(rows)[names].assign(error=None)
        except errors as error:
            blank = {c: [None] for c in names} | {k: [rows[k].iloc[0]] for k in own}
            return pd.DataFrame(blank | {"error": [f"{type(error).__name__}: {error}"]})

    return df.groupBy(*keys).applyInPandas(attempt, f"{schema}, error string")


def _said(error: Exception) -> str:
    """What says best what was wrong: the line with an error's name at its beginning, or the last error that a line names."""
    whole = f"{error}\n{getattr(error, '_stackTrace', None) or ''}"  # what Spark says, and what it says was the cause
    # Spark may add where it tried a step first, as an exception of its own.
    lines = [x.strip() for x in whole.splitlines() if x.strip() and "OriginalTryStackTraceException" not in x]
    plain = [x for x in lines if re.match(r"\w*(Error|Exception): ", x)]
    named = [x[m[-1].start() :] for x in reversed(lines) if (m := list(re.finditer(r"\w*(Error|Exception): ", x)))]
    return [*plain, *named, *lines, type(error).__name__][0][:500]


def _status_path(path: str) -> str:
    return f"{path}/status"


def statuses(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """keys, status, error and folder of all that was worked on in this place, the last word on each key; none if nothing was."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "status string, error string, folder string, at timestamp"])
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_status_path(path))
    if not spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spot):
        return spark.createDataFrame([], schema).drop("at")
    known = spark.read.schema(schema).parquet(_status_path(path))
    return known.groupBy(*keys.columns).agg(F.max_by(F.struct("status", "error", "folder"), "at").alias("s")).select(*keys.columns, "s.*")


def finished(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame | None:
    """The rows of all keys that were created, each from the folder that its status names; None if there are none."""
    done = statuses(spark, path, keys).filter(F.col("status") == CREATED)
    folders = [r.folder for r in done.select("folder").distinct().collect()]  # one for each wave or part of one
    if not folders:
        return None
    rows = spark.read.parquet(*folders).withColumn("_folder", F.regexp_extract(F.input_file_name(), r"(wave-[0-9a-f]+)/", 1))
    named = done.select(*keys.columns, F.regexp_extract("folder", r"(wave-[0-9a-f]+)$", 1).alias("_folder"))
    return joined(rows, named, [*keys.columns, "_folder"], "left_semi").drop("_folder")


def run_batch(keys: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, *, waves: int = 8, resume: bool = True) -> DataFrame:
    """keys and their status: cached (created before), created or failed, and the error.

    keys are distinct rows; work(some of them) gives rows that have the keys' columns, such as the tracks of these clips.
    What failed before is tried again. Only Exception is taken for a failure of keys: what stops the driver
    stops the batch, and the next run goes on with what is left.
    """
    spark, names = keys.sparkSession, keys.columns
    scratch = Scratch(spark)  # what is written below changes what the status says
    before = scratch.written(statuses(spark, path, keys).filter(F.col("status") == CREATED).select(*names), "created_before")
    todo = scratch.written(joined(keys, before, names, "left_anti") if resume else keys, "to_do")
    spread = F.xxhash64(*names)

    def note(some: DataFrame, status: str, error: str | None, folder: str | None) -> None:
        row = [F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), F.lit(folder).cast("string").alias("folder"), F.current_timestamp().alias("at")]
        some.select(*names, *row).coalesce(1).write.mode("append").parquet(_status_path(path))

    def attempt(some: DataFrame, bit: int) -> None:
        n = some.count()
        if not n:
            return
        folder = f"{path}/rows/wave-{uuid.uuid4().hex}"
        try:
            work(some).write.parquet(folder)
        except Exception as error:
            if n == 1 or bit > 62:
                note(some, FAILED, _said(error), None)
                return
            for half in (0, 1):
                attempt(some.filter(F.shiftrightunsigned(spread, bit).bitwiseAND(F.lit(1)) == half), bit + 1)
            return
        note(some, CREATED, None, folder)

    for wave in range(waves):
        attempt(todo.filter(F.pmod(F.xxhash64(F.lit("wave"), *names), F.lit(waves)) == wave), 0)
    now = statuses(spark, path, keys)
    was = before.select(*names, F.lit(True).alias("_was"))
    both = joined(joined(keys, now.drop("folder"), names), was, names, "left")
    cached = F.col("_was").isNotNull() & F.lit(resume)
    found = settled(both.select(*names, F.when(cached, CACHED).otherwise(F.col("status")).alias("status"), F.when(~cached, F.col("error")).alias("error")))
    scratch.cleared()
    return found
