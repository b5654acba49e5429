"""Operators over ordered rows of a key: differences, rolling statistics, runs, bridging, hysteresis, sessions.

All windows are partitioned by the key, so that rows of different keys never meet in a task; `order`
must be unique within a key. Runs are half-open in the row number and closed in the order's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def _by(keys: Names, *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def with_speed(df: DataFrame, keys: Names, t: str, x: str, y: str, out: str = "speed") -> DataFrame:
    """Distance to the row before over the time since; null for the first row and where no time has passed."""
    w = _by(keys, t)
    dt = F.nullif((F.col(t) - F.lag(t).over(w)).cast("double"), F.lit(0.0))
    return df.withColumn(out, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / dt)


def centred(n: int) -> tuple[int, int]:
    """The frame of n rows around the current one; of an even n the longer part is before it."""
    return -(n // 2), (n - 1) // 2


def rolling_mean(c: Column | str, keys: Names, order: str, n: int) -> Column:
    return F.avg(c).over(_by(keys, order).rowsBetween(*centred(n)))


def rolling_median(c: Column | str, keys: Names, order: str, n: int) -> Column:
    values = F.array_sort(F.collect_list(F.col(c) if isinstance(c, str) else c).over(_by(keys, order).rowsBetween(*centred(n))))
    k = F.size(values)
    return (F.get(values, F.floor((k - 1) / 2).cast("int")) + F.get(values, F.floor(k / 2).cast("int"))) / 2


def box_mean(c: Column | str, keys: Names, order: str, half: int = 2) -> Column:
    """The sum of 2 * half + 1 rows over their number; rows beyond the ends count as 0."""
    return F.sum(c).over(_by(keys, order).rowsBetween(-half, half)) / (2 * half + 1)


def median_step(df: DataFrame, keys: Names, order: str) -> DataFrame:
    step = (F.col(order) - F.lag(order).over(_by(keys, order))).cast("double")
    return df.withColumn("step", step).groupBy(*keys).agg(F.median("step").alias("step"))


def with_island(df: DataFrame, keys: Names, order: str, flag: Column | str, out: str = "island") -> DataFrame:
    """Numbers the runs of equal flags of each key, from 1; a null flag is false."""
    on = F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))
    w = _by(keys, order)
    return df.withColumn("_on", on).withColumn(out, F.sum(F.coalesce((F.col("_on") != F.lag("_on").over(w)).cast("int"), F.lit(1))).over(w)).drop("_on")


def runs(df: DataFrame, keys: Names, order: str, flag: Column | str, **aggregates: Column) -> DataFrame:
    """A row for each run in which the flag holds: first, last, n and the aggregates asked for."""
    held = F.col(flag) if isinstance(flag, str) else flag
    found = with_island(df, keys, order, held).filter(held)
    out = found.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    return out.drop("island")


def _with_runs(df: DataFrame, keys: Names, order: str, flag: str) -> DataFrame:
    """Adds of each row's run: its extent, length, and whether it touches an end of the key."""
    w, own = _by(keys, order), Window.partitionBy(*keys, "island")
    numbered = with_island(df, keys, order, flag)
    numbered = numbered.withColumn("_i", F.row_number().over(w)).withColumn("_size", F.count("*").over(Window.partitionBy(*keys)))
    for name, c in (("_a", F.min("_i")), ("_b", F.max("_i")), ("_t0", F.min(order)), ("_t1", F.max(order))):
        numbered = numbered.withColumn(name, c.over(own))
    return numbered.withColumn("_inner", (F.col("_a") > 1) & (F.col("_b") < F.col("_size")))


_MADE = ["island", "_i", "_size", "_a", "_b", "_t0", "_t1", "_inner"]


def bridged_by_time(df: DataFrame, keys: Names, order: str, flag: str, most: float) -> DataFrame:
    """The flag also holds in runs without it that lie between two with it and last at most so long."""
    found = _with_runs(df, keys, order, flag)
    short = F.col("_inner") & ((F.col("_t1") - F.col("_t0")).cast("double") <= most)
    return found.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | short).drop(*_MADE)


def bridged_by_count(df: DataFrame, keys: Names, order: str, flag: str, limit: int) -> DataFrame:
    """The flag also holds in gaps of rows, as a scan from left to right that fills while it looks ahead leaves them.

    Gaps of at most `limit` rows fill up; those of less than twice that keep their first rows, as many as
    they have over the limit; longer ones stay. Gaps at the ends of a key stay.
    """
    found = _with_runs(df, keys, order, flag)
    gap = F.col("_b") - F.col("_a") + 1
    fill = (gap <= limit) | ((gap < 2 * limit) & (F.col("_i") - F.col("_a") >= gap - limit))
    return found.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | (F.col("_inner") & fill)).drop(*_MADE)


def hysteresis(df: DataFrame, keys: Names, order: str, high: Column, low: Column, cut: Column, out: str = "active") -> DataFrame:
    """Rows that reach `high`, and the runs of `low` without a cut around them or next to such a row on a cut."""
    w = _by(keys, order)
    f = lambda c: F.coalesce(c, F.lit(False))
    marked = df.withColumn("_seed", f(high)).withColumn("_grow", f(low) & ~f(cut)).withColumn("_cutseed", F.col("_seed") & f(cut))
    marked = with_island(marked, keys, order, "_grow", "_run")
    touch = F.col("_seed") | F.coalesce(F.lag("_cutseed").over(w), F.lit(False)) | F.coalesce(F.lead("_cutseed").over(w), F.lit(False))
    marked = marked.withColumn("_touch", touch & F.col("_grow"))
    has = F.max("_touch").over(Window.partitionBy(*keys, "_run"))
    return marked.withColumn(out, F.col("_seed") | (F.col("_grow") & has)).drop("_seed", "_grow", "_cutseed", "_run", "_touch")


def session_groups(df: DataFrame, keys: Names, order: str, opens: Column, joins: Column) -> DataFrame:
    """Each row that opens begins a group, rows that join belong to the last group; others, and those before any group, are left out."""
    w = _by(keys, order)
    kept = df.filter(opens | joins).withColumn("group_no", F.sum(opens.cast("int")).over(w)).filter("group_no > 0")
    return kept.withColumn("group_order", F.row_number().over(_by([*keys, "group_no"], order)) - 1)


def latest(df: DataFrame, keys: Names, *order: Column) -> DataFrame:
    """The last row of each key in this order, which is descending."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def between_cuts(cuts: DataFrame, keys: Names, at: str, least: float) -> DataFrame:
    """Spans from each cut to the next that last at least so long, numbered without gaps."""
    w = _by(keys, at)
    spans = cuts.select(*keys, F.col(at).alias("start"), F.lead(at).over(w).alias("end")).filter((F.col("end") - F.col("start")).cast("double") >= least)
    return spans.withColumn("number", F.row_number().over(_by(keys, "start")))


def sustained(df: DataFrame, keys: Names, order: str, active: Column, onset: int, quiet: Column, least: Column, skip: int = 2, quiet_rows: int | None = None, margin: int = 0) -> DataFrame:
    """start: the first row after `skip` from which `onset` rows are active. end: the first row `least` rows or more after it, from which quiet_rows (as many as onset unless given) are quiet; the last row if none is.

    With a margin, so many more rows must follow. Keys without a start are left out.
    """
    w, quiet_rows = _by(keys, order), quiet_rows or onset

    def lasting(test: Column, n: int) -> Column:
        ahead = w.rowsBetween(0, n - 1)
        return (F.col("_left") >= n + margin) & (F.min(test.cast("int")).over(ahead) == 1)

    numbered = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_least", least)
    numbered = numbered.withColumn("_left", F.count("*").over(Window.partitionBy(*keys)) - F.col("_i"))
    marked = numbered.withColumn("_on", lasting(active, onset)).withColumn("_off", lasting(quiet, quiet_rows))
    starts = marked.filter((F.col("_i") >= skip) & F.col("_on")).groupBy(*keys).agg(F.min_by(F.struct("_i", order), "_i").alias("s"))
    rest = F.col("_off") & (F.col("_i") >= F.col("s")["_i"] + F.col("_least"))
    ends = marked.join(starts, list(keys)).groupBy(*keys).agg(F.coalesce(F.min(F.when(rest, F.col(order))), F.max(order)).alias("end"))
    return starts.select(*keys, F.col("s")[order].alias("start")).join(ends, list(keys))


def switches(df: DataFrame, keys: Names, order: str, value: str) -> DataFrame:
    """How often the value differs from that of the row before, for each key."""
    changed = F.coalesce((F.col(value) != F.lag(value).over(_by(keys, order))).cast("long"), F.lit(0))
    return df.withColumn("_c", changed).groupBy(*keys).agg(F.sum("_c").alias("switches"))


def state_changes(df: DataFrame, keys: Names, order: str, state: str, stable: int = 2) -> DataFrame:
    """Rows at which a state begins that lasts for `stable` rows and differs from the last such state."""
    found = with_value_runs(df, keys, order, state).groupBy(*keys, "run").agg(F.min(order).alias("at"), F.first(state).alias("state"), F.count("*").alias("n")).filter(F.col("n") >= stable)
    before = F.lag("state").over(_by(keys, "at"))
    return found.withColumn("was", before).filter(F.col("was").isNotNull() & (F.col("was") != F.col("state"))).select(*keys, "at", "was", "state")


def with_value_runs(df: DataFrame, keys: Names, order: str, value: str, out: str = "run") -> DataFrame:
    """Numbers the runs of equal values of each key."""
    w = _by(keys, order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w)).drop("_new")


def largest_gap(df: DataFrame, keys: Names, value: str) -> DataFrame:
    """The widest step between neighbours in sorted order and the place halfway; of equal ones the first."""
    w = _by(keys, value)
    gaps = df.withColumn("above", F.lead(value).over(w)).filter("above is not null").withColumn("gap", F.col("above") - F.col(value))
    best = F.max(F.struct("gap", (-F.col(value)).alias("b"), F.col("above").alias("above")))
    return gaps.groupBy(*keys).agg(best.alias("g")).select(*keys, F.col("g.gap").alias("gap"), ((F.col("g.above") - F.col("g.b")) / 2).alias("split"))


def upper_median(values: Column) -> Column:
    """The value in the middle of a sorted array; of an even number the upper of the two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def filled_forward(c: Column, keys: Names, order: str) -> Column:
    """The last value that is neither null nor 0."""
    return F.last(F.nullif(c, F.lit(0)), ignorenulls=True).over(_by(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def interpolated(value: str, at: str, keys: Names, fill: float = 0.0) -> Column:
    """Nulls become values on the line between their neighbours, or the nearest neighbour's at the ends; `fill` if there is none."""
    w = Window.partitionBy(*keys).orderBy(at)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")))
    a, b = F.last(here, ignorenulls=True).over(back), F.first(here, ignorenulls=True).over(on)
    part = (F.col(at) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0))
    line = a["v"] + (b["v"] - a["v"]) * F.coalesce(part, F.lit(0.0))
    return F.coalesce(F.col(value), line, a["v"], b["v"], F.lit(fill))
