"""Aggregations of time series, tracks and groups. Exact quantiles are linear between values, as numpy's are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.lineage import written
from .grouped import dealt, mapped_groups
from .ranks import deviating, exact_quantiles, joined, least_of_each, with_quantiles
from .sequence import interpolated

Names = Sequence[str]


def share(condition: Column) -> Column:
    """The share of all rows for which it holds; null counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rate(c: Column) -> Column:
    """The share of true among those that are not null; null if there is none."""
    return F.avg(c.cast("double"))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def timeline(df: DataFrame, keys: Names, at: str, value: str, track: str, moving: float) -> DataFrame:
    """For each time: the share of rows above `moving`, the median and the number of tracks."""
    return df.groupBy(*keys, at).agg(share(F.col(value) > moving).alias("activity"), F.median(value).alias("middle"), F.countDistinct(track).alias("tracks"))


def error_summary(df: DataFrame, keys: Names, error: str, near: float) -> DataFrame:
    """Median and 90th percentile of an error, matched and all rows, and shares; unmatched rows have a null error."""
    return with_quantiles(
        df, keys, {"median": (error, 0.5), "p90": (error, 0.9)}, F.count(error).alias("matched"), F.count("*").alias("total"),
        (F.count(error) / F.count("*")).alias("coverage"), share(F.col(error) <= near).alias("near_share"),
    ).select(*keys, "median", "p90", "matched", "total", "coverage", "near_share")


def robust_scale(df: DataFrame, keys: Names, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Quantiles of a value and its median absolute deviation, 1 where that is 0."""
    found = exact_quantiles(df, keys, {"_middle": (value, 0.5)} | {f"p{round(q * 100)}": (value, q) for q in quantiles})
    mad = exact_quantiles(joined(df, found.select(*keys, "_middle"), keys), keys, {"mad": (F.abs(F.col(value) - F.col("_middle")), 0.5)})
    return joined(found.drop("_middle"), mad.withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))), keys)


def displacement(df: DataFrame, keys: Names, track: str, at: str, x: str, y: str) -> DataFrame:
    """The median over tracks of the distance from a track's first place to its last."""
    place = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = df.groupBy(*keys, track).agg(F.min_by(place, at).alias("a"), F.max_by(place, at).alias("b"))
    return ends.groupBy(*keys).agg(F.median(F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))).alias("displacement"))


def binned_profile(df: DataFrame, keys: Names, at: str, value: str, bins: int = 8, out: str = "profile", low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The median of the value in each of `bins` equal parts of the key's time, empty parts on the line between their neighbours.

    Time goes from `low` to `high`, which are the same in all rows of a key and its least and greatest time
    unless given. What lies on an edge or beyond an end belongs to the later part, or to the part at that
    end; a key without a value has zeros.
    """
    own = Window.partitionBy(*keys)
    a, b = (F.min(at).over(own) if low is None else low).cast("double"), (F.max(at).over(own) if high is None else high).cast("double")
    edge = lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * (i.cast("double") / bins)
    binned = df.withColumn("_a", a).withColumn("_b", b)
    inner = F.filter(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: edge(i) <= F.col(at).cast("double"))
    part = F.size(inner) if low is not None else F.when(F.col("_a") == F.col("_b"), F.lit(0)).otherwise(F.size(inner))
    cells = binned.withColumn("bin", part).groupBy(*keys, "bin").agg(F.median(value).alias("v"))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(cells, [*keys, "bin"], "left").withColumn("v", interpolated("v", "bin", keys))
    return full.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"]).alias(out))


def formation(df: DataFrame, keys: Names, x: str, y: str, most: int = 22, digits: int | None = None, out: str = "formation") -> DataFrame:
    """The least distances to the middle (coordinate by coordinate) of the key's rows, in ascending order, `most` at most."""
    placed = deviating(df.select(*keys, x, y), keys, {"_mx": (x, 0.5), "_my": (y, 0.5)})
    far = placed.withColumn("_d", F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")))
    values = F.sort_array(F.collect_list(F.bround("_d", digits) if digits is not None else F.col("_d")))
    near = least_of_each(far, keys, most, F.col("_d").asc_nulls_last())
    return near.groupBy(*keys).agg(values.alias(out))


def mode(c: Column | str) -> Column:
    """The most frequent value, of equally frequent ones the least."""
    return F.mode(c, True)


def vote(df: DataFrame, keys: Names, candidate: str, weight: Column) -> DataFrame:
    """The candidate of the greatest sum of weights, of equal ones the first by name, and its share."""
    sums = df.groupBy(*keys, candidate).agg(F.sum(weight).alias("w"))
    best = F.max_by(candidate, F.struct("w", F.col("_rank")))
    w = Window.partitionBy(*keys).orderBy(F.col(candidate).desc())
    return sums.withColumn("_rank", F.row_number().over(w)).groupBy(*keys).agg(best.alias("winner"), (F.max("w") / F.sum("w")).alias("share"))


def purity(df: DataFrame, keys: Names, track: str, label: str) -> DataFrame:
    """The share of rows whose label is the most frequent one of their track."""
    counts = df.groupBy(*keys, track, label).count()
    best = counts.groupBy(*keys, track).agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.groupBy(*keys).agg((F.sum("best") / F.sum("n")).alias("purity"))


def fragments(df: DataFrame, keys: Names, track: str, label: str) -> DataFrame:
    """The mean number of tracks of a label."""
    return df.groupBy(*keys, label).agg(F.countDistinct(track).alias("n")).groupBy(*keys).agg(F.avg("n").alias("fragments"))


def track_coverage(df: DataFrame, keys: Names, track: str, at: str, reliable: float = 0.35) -> DataFrame:
    """For each track its observations, their share of the key's times (1 at most), and whether that is enough."""
    times = df.groupBy(*keys).agg(F.countDistinct(at).alias("times"))
    own = df.groupBy(*keys, track).agg(F.count("*").alias("observations"))
    cover = F.least(F.lit(1.0), F.col("observations") / F.col("times"))
    return own.join(times, list(keys)).withColumn("coverage", cover).withColumn("reliable", cover >= reliable)


def median_vector(df: DataFrame, keys: Names, vector: str, out: str = "vector") -> DataFrame:
    """The median of each dimension."""
    cells = df.select(*keys, F.posexplode(vector).alias("i", "v")).groupBy(*keys, "i").agg(F.median(F.col("v").cast("double")).alias("v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(out))


def middle_rows(lists: pa.ListArray) -> list[float | None]:
    """The median of each place of the lists, of those that have a value there; NaN is the greatest value."""
    sizes, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten()
    if not lists.null_count and not values.null_count and len(sizes) and (sizes == sizes[0]).all():
        whole = np.sort(values.to_numpy().astype(float).reshape(len(lists), -1), axis=0)
        low, high = whole[(len(whole) - 1) // 2], whole[len(whole) // 2]
        return np.where(low == high, low, 0.5 * low + 0.5 * high).tolist()
    found, rows = [], lists.to_pylist()
    for i in range(max((len(r) for r in rows if r is not None), default=0)):
        column = np.sort(np.array([r[i] for r in rows if r is not None and i < len(r) and r[i] is not None], float))
        found.append(None if not len(column) else float(0.5 * column[(len(column) - 1) // 2] + 0.5 * column[len(column) // 2]))
    return found


def middle_vectors(df: DataFrame, keys: Names, track: str, vector: str, out: str = "vector") -> DataFrame:
    """median_vector() for each track of each key, where a key's rows are few, as those of a clip: they are one task's, and no value of a vector is a row."""

    def run(part: pa.Table) -> dict[str, pa.Array]:
        name, lists = part.column(track).combine_chunks(), part.column(vector).combine_chunks()
        code = pc.dictionary_encode(name, null_encoding="encode")
        order = np.argsort(code.indices.to_numpy(), kind="stable")
        own = code.indices.to_numpy()[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lists = lists.take(pa.array(order))
        middles = [middle_rows(lists.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(own)])]
        there = [i for i, m in enumerate(middles) if m]
        return {track: code.dictionary.take(pa.array(own[starts][there])), out: pa.array([middles[i] for i in there], pa.list_(pa.float64()))}

    kind = df.schema[track].dataType.simpleString()
    return mapped_groups(df.select(*keys, track, vector), keys, run, f"{track} {kind}, {out} array<double>")


def tracklet_summary(df: DataFrame, keys: Names, track: str, at: str, columns: Names, team: str) -> DataFrame:
    """First and last row, number of rows and modal known team of each track."""
    row = F.struct(at, *columns)
    known = F.when(F.col(team) != "unknown", F.col(team))
    return df.groupBy(*keys, track).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"), F.count("*").alias("n"), F.coalesce(mode(known), F.lit("unknown")).alias("team"))


def covered_length(df: DataFrame, keys: Names, start: str, end: str) -> DataFrame:
    """The length of the union of intervals, its number of separate parts, and its share of the whole span.

    A task sorts and sums up half a million rows or so, whatever the table's size, but for a key that has more.
    """
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt(df, keys, 500_000).withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("_part", F.sum("_new").over(w))
    merged = parts.groupBy(*keys, "_part").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    length = F.sum(F.col("b") - F.col("a"))
    return merged.groupBy(*keys).agg(length.alias("length"), F.count("*").alias("parts"), (length / F.nullif(F.max("b") - F.min("a"), F.lit(0))).alias("cover"))


def densest_band(df: DataFrame, keys: Names, value: str, half: float = 1.0, step: float = 0.25, grid: tuple[Column, Column] | None = None) -> DataFrame:
    """How many values lie in the fullest band of +- half around a centre, and the median of the centres of such bands.

    Centres are the multiples of step or, given a grid of (first, number), so many of them from the first
    one on. Each value goes to the centres it can reach, a fixed number, and these are counted.
    """
    if grid is None:
        k0 = F.ceil((F.col(value) - half) / step).cast("long")
        k1 = F.floor((F.col(value) + half) / step).cast("long")
        near = df.select(*keys, F.explode(F.sequence(k0, k1)).alias("_k")).withColumn("_at", F.col("_k") * F.lit(step))
    else:
        first, number = grid
        rows = df.withColumn("_first", first.cast("double")).withColumn("_last", number.cast("long") - 1)
        k0 = F.greatest(F.floor((F.col(value) - half - F.col("_first")) / step), F.lit(0))
        k1 = F.least(F.ceil((F.col(value) + half - F.col("_first")) / step), F.col("_last"))
        near = rows.select(*keys, F.col(value).alias("_v"), "_first", F.explode(F.sequence(k0, k1)).alias("_k"))
        near = near.withColumn("_at", F.col("_first") + F.col("_k") * F.lit(step)).filter(F.abs(F.col("_v") - F.col("_at")) <= half)
    counts = near.groupBy(*keys, "_k").agg(F.count("*").alias("count"), F.first("_at").alias("_at"))
    counts = written(counts, "band_counts")
    best = joined(counts, counts.groupBy(*keys).agg(F.max("count").alias("members")), keys).filter("count = members")
    found = with_quantiles(best, keys, {"centre": ("_at", 0.5)}, F.max("members").alias("members"))
    return found.select(*keys, "members", "centre")


def histogram(df: DataFrame, keys: Names, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows in each of `bins` equal parts of low to high; values at or beyond an end are in its part."""
    part = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, part.alias("bin")).agg(F.count("*").alias("n"))


def lloyd(points: DataFrame, centres: DataFrame, id: str, vector: str, rounds: int) -> DataFrame:
    """Each point's cluster after so many rounds of k-means from given centres (cluster, center).

    Each round is one aggregation; the centres, a few rows, are all that is collected between rounds.
    """
    spark = points.sparkSession
    from .joins import nearest_centroid

    kind = centres.schema
    for _ in range(rounds):
        own = points.join(nearest_centroid(points, centres, [id], vector, "cluster", "center"), id)
        cells = own.select("nearest", F.posexplode(vector).alias("i", "v")).groupBy("nearest", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
        means = cells.groupBy("nearest").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("center")).collect()
        moved = {r["nearest"]: r["center"] for r in means}
        centres = spark.createDataFrame([(r["cluster"], moved.get(r["cluster"], r["center"])) for r in centres.collect()], kind)
    return nearest_centroid(points, centres, [id], vector, "cluster", "center")


def farthest_first(points: DataFrame, id: str, vector: str, first: Column, k: int) -> DataFrame:
    """k centres: the point least by `first`, then each time the one farthest from all chosen; ties by id."""
    spark = points.sparkSession
    from ..functions.arrays import euclid

    rows = [points.orderBy(first, id).select(F.col(vector).cast("array<double>").alias("c")).first()["c"]]
    while len(rows) < k:
        near = F.array_min(F.array(*[euclid(F.col(vector).cast("array<double>"), F.array(*[F.lit(v) for v in c])) for c in rows]))
        rows.append(points.orderBy(near.desc(), id).select(F.col(vector).cast("array<double>").alias("c")).first()["c"])
    return spark.createDataFrame(list(enumerate(rows)), "cluster int, center array<double>")
