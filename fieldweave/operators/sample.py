"""Ordering, top rows and samples that come out the same at every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_unit
from ..sinks.lineage import bounded
from .ranks import FEW_GROUPS, joined, least_of_each, ranked


def stratified_middle_out(df: DataFrame, strata: Sequence[str], order: str, n: int, across: Sequence[str] = ()) -> DataFrame:
    """n rows taken in turn from all strata in sorted order, each time the middle one of those a stratum has left.

    The turn at which a row comes out follows from its rank and the size of its stratum, so no loop is
    needed; `across` separates samples from each other. Ranks come from one sort by ranges, whatever a stratum's
    size; only rows whose turn can come are ordered after that.
    """
    rows = ranked(df, [*across, *strata], [F.col(order).asc_nulls_first()], rank="_i", size="_n")
    d, odd = F.col("_i") - F.floor(F.col("_n") / 2), F.col("_n") % 2 == 1
    turn = F.when(d == 0, 0).when(odd, F.when(d > 0, 2 * d - 1).otherwise(-2 * d)).otherwise(F.when(d < 0, -2 * d - 1).otherwise(2 * d))
    made = rows.withColumn("turn", turn.cast("long")).drop("_i", "_n").filter(F.col("turn") < n)
    if not across:
        return made.orderBy("turn", *strata).limit(n)
    return least_of_each(made, across, n, *map(F.col, ("turn", *strata)))


def hash_split(df: DataFrame, id: str, share: float = 0.5, names: tuple[str, str] = ("validation", "test"), out: str = "split") -> DataFrame:
    """Two parts by a hash of the id, the same wherever the row stands."""
    return df.withColumn(out, F.when(hash_unit(F.col(id).cast("string")) < share, names[0]).otherwise(names[1]))


def best(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that ends with a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    if n < 1:
        raise ValueError("the limit must be 1 or more")
    return df.orderBy(*order).limit(n)


def every_nth_time(df: DataFrame, keys: Sequence[str], at: str, n: int) -> DataFrame:
    """Rows at every n-th distinct time of their key, the first included."""
    w = Window.partitionBy(*keys).orderBy(at)
    return df.withColumn("_r", F.dense_rank().over(w)).filter(F.pmod(F.col("_r") - 1, F.lit(n)) == 0).drop("_r")


def reliable_or_all(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Only rows with the flag, where their key has any; else all of the key."""
    held = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumn("_any", F.max(held).over(Window.partitionBy(*keys))).filter(~F.col("_any") | held).drop("_any")


def preferred(df: DataFrame, flags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Of each key the rows with the first of the flags that it knows; all rows of a key that knows none.

    A key knows a flag if any of its rows has it, true or false: artifacts of before the flag have nulls, or no such column.
    """
    there = [f for f in flags if f in df.columns]
    if not there:
        return df
    known = df.groupBy(*keys).agg(*[F.max(F.col(f).isNotNull()).alias(f"_knows_{f}") for f in there])
    both = joined(df, bounded(known, FEW_GROUPS), keys)
    keep = F.lit(True)
    for f in reversed(there):
        keep = F.when(F.col(f"_knows_{f}"), F.coalesce(F.col(f), F.lit(False))).otherwise(keep)
    return both.filter(keep).select(*df.columns)
