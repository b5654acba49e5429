"""Sequential operators. Those whose choice follows from the last row kept are chains (operators.chains); the others are one fold for each key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import folds
from .chains import coalesced, min_separation

__all__ = ["best_of_neighbours", "clusters_1d", "coalesced", "longest_apart", "merged_fragments", "min_separation"]


def _picked(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        return rows.iloc[pick(rows)]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def _grouped(df: DataFrame, keys: Sequence[str], order: Sequence[str], group: Callable[[pd.DataFrame], np.ndarray], out: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable")
        return rows.assign(**{out: group(rows)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` long"
    return df.groupBy(*keys).applyInPandas(run, schema)


def best_of_neighbours(df: DataFrame, keys: Sequence[str], at: str, score: str, least: float) -> DataFrame:
    return _picked(df, keys, [at], lambda x: folds.thinned_to_best(x[at].to_numpy(float), x[score].to_numpy(float), least))


def merged_fragments(clips: DataFrame, keys: Sequence[str], touch: float = 0.05, short: float = 5.0) -> DataFrame:
    """Clips with short fragments taken into their neighbours: keys, clip_id, angle, start_s, end_s, snap_s, play_end_s and confidence.

    The first fragment gives its id, start and, if it has one, snap; the last one its end; confidence is the greatest.
    """
    parts = coalesced(clips, keys, "start_s", "end_s", "angle", touch, short)
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("start_s")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("start_s")))
    merged = parts.groupBy(*keys, "part").agg(
        F.min_by("clip_id", "start_s").alias("clip_id"), F.first("angle").alias("angle"), F.max_by("end_s", "start_s").alias("end_s"),
        earliest("snap_s").alias("snap_s"), latest("play_end_s").alias("play_end_s"), F.max("confidence").alias("confidence"), F.min("start_s").alias("start_s"),
    )
    return merged.select(*keys, "clip_id", "angle", "start_s", "end_s", "snap_s", "play_end_s", "confidence")


def clusters_1d(df: DataFrame, keys: Sequence[str], offset: str, reach: float, out: str = "cluster") -> DataFrame:
    return _grouped(df, keys, [offset], lambda x: folds.clustered(x[offset].to_numpy(float), reach), out)


def longest_apart(df: DataFrame, keys: Sequence[str], length: str, offset: str, least: float) -> DataFrame:
    return _picked(df, keys, [offset], lambda x: folds.longest_apart(x[length].to_numpy(float), x[offset].to_numpy(float), least))
