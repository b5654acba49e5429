"""Greedy choices along ordered rows as chains of pointers, followed by doubling: no key is held in one task.

Where what is kept next depends on the last row kept alone, each row has one pointer to the row that would be kept after it. What
is kept is the chain from the first row; joining the pointers with themselves doubles their length, so that the
number of rounds is the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.lineage import Scratch
from .ranks import joined, ranked

Names = Sequence[str]


def first_after(targets: DataFrame, probes: DataFrame, keys: Names, at: Column, *, strictly: bool, scratch: Scratch, out: str = "_found") -> DataFrame:
    """probes with how many of their key's targets lie before `at`, and for strictly at it: the rank of the first one after it.

    at is a column of both. Null keys are keys.
    """
    plain = targets.select(*keys, at.alias("_at"), F.lit(1).alias("_one"), F.lit(0 if strictly else 1).alias("_turn"))
    asking = probes.withColumns({"_at": at, "_one": F.lit(0), "_turn": F.lit(1 if strictly else 0)})
    both = asking.unionByName(plain, allowMissingColumns=True)
    placed = ranked(both, keys, [F.col("_at").asc_nulls_first(), F.col("_turn")], weight="_one", rank=out, size="_all", scratch=scratch)
    return placed.filter("_one = 0").drop("_at", "_one", "_turn", "_all")


def chained(heads: DataFrame, pointers: DataFrame, keys: Names, scratch: Scratch) -> DataFrame:
    """keys and _i of all rows on the chains that begin at heads (keys, _i), by pointers (keys, _i, _j)."""
    node = [*keys, "_i"]
    to = pointers.select(*keys, F.col("_j").alias("_i"))
    # Only heads and rows that something points to can be on a chain.
    known = to.unionByName(heads.select(*node)).distinct()
    jumps = scratch.written(joined(pointers.select(*node, "_j"), known, node, "left_semi"), "jumps")
    found = scratch.written(heads.select(*node).distinct(), "chain")
    while True:
        far = joined(found, jumps, node).select(*keys, F.col("_j").alias("_i"))
        longer = scratch.written(found.unionByName(far).distinct(), "chain")
        if longer.count() == found.count():
            scratch.cleared(*[t for t in scratch.tables if t is not jumps and t is not found])
            return longer
        beyond = jumps.select(*keys, F.col("_i").alias("_from"), F.col("_j").alias("_i"))
        doubled = scratch.written(joined(beyond, jumps, node).select(*keys, F.col("_from").alias("_i"), "_j"), "jumps")
        scratch.cleared(*[t for t in scratch.tables if t is not jumps and t is not found])
        found, jumps = longer, doubled


def min_separation(df: DataFrame, keys: Names, at: str, least: float) -> DataFrame:
    """Rows at least so far after the last row kept, the first of each key included; of equal times the first in df's order.

    A row can follow one at t from t + least on. Rows without a time are left out.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.written(ranked(df.filter(F.col(at).isNotNull()), keys, [F.col(at)], rank="_i", size="_size", scratch=scratch), "separated")
    scratch.cleared(rows)
    ahead = first_after(rows.select(*keys, F.col(at).alias("_t")), rows.select(*keys, "_i", "_size", (F.col(at) + F.lit(least)).alias("_t")), keys, F.col("_t"), strictly=False, scratch=scratch, out="_j")
    pointers = scratch.written(ahead.filter(F.col("_j") < F.col("_size")).select(*keys, "_i", "_j"), "pointers")
    kept = chained(rows.filter("_i = 0").select(*keys, "_i"), pointers, keys, scratch)
    out = joined(rows, kept, [*keys, "_i"], "left_semi").select(*df.columns)
    scratch.cleared(rows, kept)
    return out


def coalesced(df: DataFrame, keys: Names, start: str, end: str, kind: str, touch: float = 0.05, short: float = 5.0, out: str = "part") -> DataFrame:
    """Numbers, from 0, the groups of touching fragments of one kind, each in a key's order of start.

    A fragment begins a group if it is of another kind than the one before it or doesn't touch it, or if both it and the
    group so far last longer than `short`. Fragments don't overlap.
    """
    scratch = Scratch(df.sparkSession)
    rows = ranked(df, keys, [F.col(start)], rank="_i", size="_size", scratch=scratch)
    last = rows.select(*keys, (F.col("_i") + 1).alias("_i"), F.col(end).alias("_end"), F.col(kind).alias("_kind"))
    apart = F.coalesce(~F.col(kind).eqNullSafe(F.col("_kind")) | (F.abs(F.col(start) - F.col("_end")) >= touch), F.lit(True)) | (F.col("_i") == 0)
    flagged = joined(rows, last, [*keys, "_i"], "left").withColumn("_apart", apart.cast("int")).withColumn("_long", F.col(end) - F.col(start) > short)
    runs = ranked(flagged, keys, [F.col("_i")], weight="_apart", rank="_run", size="_runs", scratch=scratch)
    runs = scratch.written(runs.withColumn("_run", F.col("_run") + F.col("_apart")), "runs")
    own = [*keys, "_run"]
    # In a run, a long fragment cuts a group off as soon as the fragments before it have lasted long enough.
    cutting = scratch.written(ranked(runs.filter("_long and _apart = 0").select(*own, "_end", F.col("_i").alias("_j")), own, [F.col("_end"), F.col("_j")], rank="_place", size="_cuts", scratch=scratch), "cutting")
    probes = runs.select(*own, "_i", (F.col(start) + F.lit(short)).alias("_reach"))
    placed = first_after(cutting.select(*own, F.col("_end").alias("_reach")), probes, own, F.col("_reach"), strictly=True, scratch=scratch, out="_place")
    pointers = scratch.written(joined(placed, cutting.select(*own, "_place", "_j"), [*own, "_place"]).select(*keys, "_i", "_j"), "pointers")
    begins = chained(runs.filter("_apart = 1").select(*keys, "_i"), pointers, keys, scratch)
    marked = joined(runs, begins.withColumn("_begins", F.lit(1)), [*keys, "_i"], "left")
    numbered = ranked(marked, keys, [F.col("_i")], weight="_begins", rank="_earlier", size="_parts", scratch=scratch)
    numbered = scratch.written(numbered.select(*df.columns, (F.col("_earlier") + F.coalesce("_begins", F.lit(0)) - 1).alias(out)), "parts")
    scratch.cleared(numbered)
    return numbered
