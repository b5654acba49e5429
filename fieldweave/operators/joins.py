"""Joins over time, order and space. Every join has an equality key; ranges are cut into buckets of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Names, left_at: str, right_at: str, columns: Names, *, valid_within: Column | float | None = None) -> DataFrame:
    """Each left row with the right row of its keys nearest in time, and how far it is; of equally near ones the earlier.

    The two sides are merged by one sort for each key, so that neither pairs nor ranges are made: the last
    right row at or before a left row and the first one after it are all that can be nearest. left rows
    without any keep nulls. valid: whether the distance is within valid_within.
    """
    t = "_t"
    lefts = left.withColumn(t, F.col(left_at).cast("double")).withColumn("_side", F.lit(1))
    right_row = F.struct(F.col(right_at).cast("double").alias("t"), *[F.col(c) for c in columns])
    rights = right.groupBy(*keys, right_at).agg(*[F.first(c).alias(c) for c in columns if c not in {*keys, right_at}]).select(*keys, right_row.alias("_r")).withColumn(t, F.col("_r.t")).withColumn("_side", F.lit(0))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(t, "_side")
    before = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_a", before).withColumn("_b", after).filter("_side = 1")
    far = F.col("_b.t") - F.col(t)
    back = F.col(t) - F.col("_a.t")
    found = found.withColumn("_n", F.when(F.col("_b").isNull() | (back <= far), F.col("_a")).otherwise(F.col("_b")))
    found = found.withColumn("distance", F.abs(F.col("_n.t") - F.col(t)))
    for c in columns:
        found = found.withColumn(c if c not in left.columns else f"near_{c}", F.col(f"_n.{c}"))
    if valid_within is not None:
        limit = valid_within if isinstance(valid_within, Column) else F.lit(valid_within)
        found = found.withColumn("valid", F.coalesce(F.col("distance") <= limit, F.lit(False)))
    return found.drop(t, "_side", "_r", "_a", "_b", "_n")


def validity_reach(keyframes: DataFrame, keys: Names, at: str, share: float = 0.75, least: float = 0.075, nominal: float = 0.1) -> DataFrame:
    """How far from its keyframes each key is valid: a share of their median step, which is nominal for a single one."""
    step = (F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))).cast("double")
    return keyframes.withColumn("_s", step).groupBy(*keys).agg(F.greatest(F.lit(least), share * F.coalesce(F.median("_s"), F.lit(nominal))).alias("reach"))


def rows_nearest_to(df: DataFrame, keys: Names, at: str, target: Column, tolerance: float = 0.02) -> DataFrame:
    """Rows whose distance to the target is the least of their key's, within a tolerance."""
    gap = F.abs(F.col(at) - target)
    return df.withColumn("_gap", gap).withColumn("_least", F.min("_gap").over(Window.partitionBy(*keys))).filter(F.col("_gap") <= F.col("_least") + tolerance).drop("_gap", "_least")


def following_within(left: DataFrame, right: DataFrame, keys: Names, end: str, start: str, most: float) -> DataFrame:
    """Pairs with 0 < right start - left end <= most, joined by buckets of that width; columns are prefixed l_ and r_, keys stay."""
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    at = F.floor(F.col(f"l_{end}").cast("double") / most)
    a = a.withColumn("_bucket", F.explode(F.array(at, at + 1)))
    b = b.withColumn("_bucket", F.floor(F.col(f"r_{start}").cast("double") / most))
    gap = (F.col(f"r_{start}") - F.col(f"l_{end}")).cast("double")
    return a.join(b, [*keys, "_bucket"]).withColumn("gap", gap).filter((gap > 0) & (gap <= most)).drop("_bucket")


def looking_ahead(df: DataFrame, keys: Names, order: str, n: int) -> DataFrame:
    """Each row with each of the n rows after it in its key; columns of the later one are prefixed other_."""
    w = Window.partitionBy(*keys).orderBy(order)
    rest = [c for c in df.columns if c not in keys]
    later = F.array(*[F.lead(F.struct(*rest), i).over(w) for i in range(1, n + 1)])
    paired = df.withColumn("_later", later).select(*df.columns, F.posexplode("_later").alias("step", "_o")).filter("_o is not null")
    return paired.select(*df.columns, (F.col("step") + 1).alias("step"), *[F.col(f"_o.{c}").alias(f"other_{c}") for c in rest])


def at_frame(df: DataFrame, out: str, snap_frame: Column, at: Column, snap_at: Column, offset: Column, rate: float = 10.0) -> DataFrame:
    """The frame of another clock that a time falls on, halves to even ones."""
    return df.withColumn(out, (snap_frame + F.rint((at - snap_at + offset) * rate)).cast("long"))


def with_existence(df: DataFrame, other: DataFrame, keys: Names, out: str = "present") -> DataFrame:
    """Whether other has a row of the same keys, as a column."""
    marks = other.select(*keys).distinct().withColumn("_mark", F.lit(True))
    return df.join(marks, list(keys), "left").withColumn(out, F.coalesce("_mark", F.lit(False))).drop("_mark")


def top_one(df: DataFrame, other: DataFrame, keys: Names, columns: Names, *order: Column) -> DataFrame:
    """Each row with the first of the other's rows of its keys in an order, or nulls: a correlated subquery with LIMIT 1."""
    best = other.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").select(*keys, *columns)
    return df.join(best, list(keys), "left")


def nearest_neighbour(df: DataFrame, keys: Names, id: str, x: str, y: str, out: str = "spacing") -> DataFrame:
    """The distance to the nearest other row of the same keys; null for a row alone. Keys hold few rows, such as those of a frame."""
    other = df.select(*keys, F.col(id).alias("_id"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = df.join(other, list(keys)).filter(F.col(id) != F.col("_id"))
    near = pairs.groupBy(*keys, id).agg(F.min(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias(out))
    return df.join(near, [*keys, id], "left")


def nearest_centroid(df: DataFrame, centroids: DataFrame, id: Names, vector: str, label: str, center: str, by: Names = ()) -> DataFrame:
    """The nearest centroid's label of each row, its distance, and 1 - nearest / second nearest as confidence.

    centroids has few rows, a documented bound of the model that made them; with `by` those of the row's key.
    """
    listed = centroids.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(center).alias("center")))).alias("_all")) if by else None
    if by:
        joined = df.join(listed, list(by))
    else:
        rows = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(center).alias("center")))).alias("_all"))
        joined = df.withColumn("_one", F.lit(1)).join(F.broadcast(rows.withColumn("_one", F.lit(1))), "_one").drop("_one")
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    ranked = joined.withColumn("_d", F.array_sort(F.transform("_all", lambda c: F.struct(F.sqrt(square(c["center"])).alias("d"), c["label"].alias("label")))))
    first, second = F.get(F.col("_d"), F.lit(0)), F.get(F.col("_d"), F.lit(1))
    confidence = F.coalesce(1 - first["d"] / F.nullif(second["d"], F.lit(0.0)), F.lit(0.0))
    return ranked.select(*id, first["label"].alias("nearest"), first["d"].alias("distance"), confidence.alias("confidence"))


def differing(frozen: DataFrame, current: DataFrame, keys: Names, columns: Names) -> DataFrame:
    """A row for each column of each key in which the two differ, nulls equal to nulls; missing keys differ as a whole."""
    a = frozen.select(*keys, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(True).alias("_in_f"))
    b = current.select(*keys, *[F.col(c).alias(f"_c_{c}") for c in columns], F.lit(True).alias("_in_c"))
    both = a.join(b, list(keys), "full")
    tests = [F.when(F.col("_in_f").isNull(), F.lit("added")), F.when(F.col("_in_c").isNull(), F.lit("missing"))]
    tests += [F.when(F.col("_in_f") & F.col("_in_c") & ~F.col(f"_f_{c}").eqNullSafe(F.col(f"_c_{c}")), F.lit(c)) for c in columns]
    return both.select(*keys, F.explode(F.array_compact(F.array(*tests))).alias("difference"))
