"""Ranks, quantiles and samples of groups of any size: one sort by ranges, in which a large group is many tasks.

No window holds a group. Rows are sorted by group and order over ranges; a row's rank is its number in its
range plus what earlier ranges have of its group, and a group has as many runs as there are ranges, at most.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.lineage import Scratch, bounded, written

Names = Sequence[str]

#: Rows of a table of groups that is broadcast; a larger one is joined.
FEW_GROUPS = 100_000


def joined(left: DataFrame, right: DataFrame, keys: Names, how: str = "inner") -> DataFrame:
    """left with right's other columns, by keys of which nulls are equal."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]) if keys else F.lit(True)
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))


def ranked(df: DataFrame, keys: Names, order: Sequence[Column], *, weight: str | None = None, rank: str = "rank", size: str = "size", scratch: Scratch | None = None) -> DataFrame:
    """df with each row's rank in its key, from 0, and the key's size; of weights, how much comes before it and the key's sum.

    Rows that are equal in the order come in the order they have in df, so that even a key whose rows all
    tie is cut. Null keys are a key; null weights count as 0.
    """
    own = scratch or Scratch(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col("_rank_tie")]
    rows = df.withColumn("_rank_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_rank_tie")
    rows = own.written(rows.withColumn("_rank_number", F.monotonically_increasing_id()), "ranked").withColumn("_rank_range", F.shiftright("_rank_number", 33))
    amount = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1)
    runs = rows.groupBy(*keys, "_rank_range").agg(F.min("_rank_number").alias("_rank_first"), F.sum(amount).alias("_rank_amount"))
    key = Window.partitionBy(*keys)
    before = F.sum("_rank_amount").over(key.orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*keys, "_rank_range", "_rank_first", F.coalesce(before, F.lit(0)).alias("_rank_before"), F.sum("_rank_amount").over(key).alias(size))
    out = joined(rows, runs, [*keys, "_rank_range"])
    inside = F.col("_rank_number") - F.col("_rank_first")
    if weight:
        run = Window.partitionBy(*keys, "_rank_range").orderBy("_rank_number").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum(amount).over(run), F.lit(0))
    return out.withColumn(rank, F.col("_rank_before") + inside).drop("_rank_number", "_rank_range", "_rank_first", "_rank_before")


def exact_quantiles(df: DataFrame, keys: Names, wanted: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """keys and, for each name, a quantile of a value, linear between its values as numpy's are; null if there is none.

    wanted has (value, quantile) for each name; null values don't count. Equal values of a group are counted before anything moves,
    and all quantiles come out of one sort. The result is a table of its own, one row for each key.
    """
    values: list[str | Column] = []
    places = {}
    for name, (value, q) in wanted.items():
        at = next((i for i, v in enumerate(values) if v is value or isinstance(v, str) and isinstance(value, str) and v == value), len(values))
        values += [value] if at == len(values) else []
        places[name] = (at, q)
    cells = [F.struct(F.lit(i).alias("of"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v")) for i, v in enumerate(values)]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("_cell")).select(*keys, F.col("_cell.of").alias("_of"), F.col("_cell.v").alias("_v"))
    scratch = Scratch(df.sparkSession)
    counts = scratch.written(long.groupBy(*keys, "_of", "_v").agg(F.count("*").alias("_n")), "value_counts")
    known = ranked(counts.filter("_v is not null"), [*keys, "_of"], [F.col("_v")], weight="_n", rank="_rank", size="_size", scratch=scratch)
    rows = known.unionByName(counts.filter("_v is null"), allowMissingColumns=True)
    found, out = [], []
    for i, (name, (of, q)) in enumerate(places.items()):
        at = F.lit(float(q)) * (F.col("_size") - 1)
        mine = F.col("_of") == of
        holds = lambda place: mine & (F.col("_rank") <= place) & (place < F.col("_rank") + F.col("_n"))  # noqa: B023, E731
        found += [F.max(F.when(holds(F.floor(at)), F.col("_v"))).alias(f"_low{i}"), F.max(F.when(holds(F.ceil(at)), F.col("_v"))).alias(f"_high{i}"), F.max(F.when(mine, at - F.floor(at))).alias(f"_part{i}")]
        low, high, part = (F.col(f"_{c}{i}") for c in ("low", "high", "part"))
        out.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    made = written(rows.groupBy(*keys).agg(*found).select(*keys, *out), "quantiles")
    scratch.cleared()
    return made


def with_quantiles(df: DataFrame, keys: Names, wanted: Mapping[str, tuple[str | Column, float]], *aggregates: Column) -> DataFrame:
    """keys, aggregates and exact quantiles of each key."""
    found = exact_quantiles(df, keys, wanted)
    return joined(df.groupBy(*keys).agg(*aggregates), bounded(found, FEW_GROUPS), keys) if aggregates else found


def deviating(df: DataFrame, keys: Names, wanted: Mapping[str, tuple[str | Column, float]]) -> DataFrame:
    """df with quantiles of its key beside each row."""
    return joined(df, bounded(exact_quantiles(df, keys, wanted), FEW_GROUPS), keys)


def least_of_each(df: DataFrame, keys: Names, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key: at most n of a key leave a task, so a large key is no large task."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")
