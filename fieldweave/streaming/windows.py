"""Event-time streams: binned rates, sessions, nearest static rows and files not yet done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, at: str, width: str, late: str, keys: Sequence[str], value: str) -> DataFrame:
    """Count, sum and mean of each key and time bin; rows later than `late` are left out."""
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), *keys, "n", "total", "mean")


def sessions(stream: DataFrame, at: str, gap: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Runs of rows of each key with less than `gap` between them."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def with_nearest_static(stream: DataFrame, frames: DataFrame, keys: Sequence[str], at: str, frame_at: str, reach: float, columns: Sequence[str]) -> DataFrame:
    """Rows of a stream with the static row nearest in time within reach, for lists of static rows that are short for each key."""
    listed = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(frame_at).cast("double").alias("t"), *columns))).alias("_all"))
    t = F.col(at).cast("double")
    best = F.array_min(F.transform("_all", lambda f: F.struct(F.abs(f["t"] - t).alias("d"), f["t"].alias("t"), *[f[c].alias(c) for c in columns])))
    joined = stream.join(listed, list(keys), "left").withColumn("_n", best).drop("_all")
    near = F.coalesce(F.col("_n.d") <= reach, F.lit(False))
    return joined.withColumns({c: F.when(near, F.col(f"_n.{c}")) for c in columns} | {"valid": near}).drop("_n")
