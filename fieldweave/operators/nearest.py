"""Mutual nearest vectors of two sides, exactly, without a row for each pair.

Rows are cut into blocks around a few pivots of their key. What a block is away from another follows from their pivots' distance and
their radii, so blocks that can't hold a nearest vector never meet; how far a nearest vector can be is known
once each block has met the block it is closest to. Blocks that meet are compared as matrices in one task call, of which only each
row's best few leave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import euclid
from ..sinks.lineage import Scratch, bounded, written
from .ranks import FEW_GROUPS, joined, least_of_each

Names = Sequence[str]
_MADE = "side int, id long, d double, other long"


def _blocks(rows: DataFrame, key: Names, pivots: int, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, side, cell, block, ids, vectors, radius, n) of rows (key, side, id, v), and (key, cell, pair, d), the distances of pivots."""
    hashed = rows.withColumn("_h", F.xxhash64("id", "side"))
    chosen = least_of_each(hashed, key, pivots, F.col("_h"), F.col("id"), F.col("side"))
    lists = scratch.written(chosen.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_h", "id", "v"))).alias("_pivots")), "pivots")
    near = F.array_min(F.transform("_pivots", lambda p, i: F.struct(euclid(F.col("v"), p["v"]).alias("d"), i.alias("cell"))))
    placed = scratch.written(joined(rows, bounded(lists, FEW_GROUPS), key).withColumn("_near", near).select(*key, "side", "id", "v", F.col("_near.d").alias("d"), F.col("_near.cell").alias("cell")), "placed")
    parts = placed.groupBy(*key, "side", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    dealt = joined(placed, parts, [*key, "side", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    made = dealt.groupBy(*key, "side", "cell", "block").agg(F.collect_list(F.struct("id", "v")).alias("_rows"), F.max("d").alias("radius"), F.count("*").alias("n"))
    made = made.select(*key, "side", "cell", "block", "_rows.id", F.flatten("_rows.v").alias("v"), "radius", "n").withColumnRenamed("id", "ids")
    one = lists.select(*key, "_pivots", F.posexplode("_pivots").alias("cell", "_p"))
    apart = one.select(*key, "cell", F.posexplode(F.transform("_pivots", lambda q: euclid(F.col("_p.v"), q["v"]))).alias("pair", "d"))
    return scratch.written(made, "blocks"), scratch.written(apart, "pivot_distances")


def _compared(pairs: DataFrame, blocks: DataFrame, key: Names) -> DataFrame:
    """Of each pair of blocks (key, cell, block, other_cell, other_block): a left row's two nearest right ones, a right row's nearest left one."""
    place = [*key, "cell", "block"]
    left = blocks.filter("side = 0").select(*place, F.col("ids").alias("a_ids"), F.col("v").alias("a"))
    right = blocks.filter("side = 1").select(*key, F.col("cell").alias("other_cell"), F.col("block").alias("other_block"), F.col("ids").alias("b_ids"), F.col("v").alias("b"))
    both = joined(joined(pairs, left, place), right, [*key, "other_cell", "other_block"]).select(*key, "a_ids", "a", "b_ids", "b")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name in key), _MADE])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, other, a, b = (batch.column(c)[n].values.to_numpy() for c in ("a_ids", "b_ids", "a", "b"))
                a, b = a.reshape(len(ids), -1), b.reshape(len(other), -1)
                d = np.empty((len(ids), len(other)))
                for i in range(0, len(ids), 32):
                    d[i : i + 32] = np.sqrt(((a[i : i + 32, None] - b[None]) ** 2).sum(axis=2))
                order = np.argsort(other, kind="stable")  # of equally near ones the least id
                d, other = d[:, order], other[order]
                best = np.argsort(d, axis=1, kind="stable")[:, :2]
                up = np.argsort(ids, kind="stable")
                back = up[np.argmin(d[up], axis=0)]
                k = best.shape[1]
                columns = [
                    np.repeat([0, 1], [k * len(ids), len(other)]).astype(np.int32), np.concatenate([np.repeat(ids, k), other]),
                    np.concatenate([np.take_along_axis(d, best, 1).ravel(), d[back, np.arange(len(other))]]), np.concatenate([other[best].ravel(), ids[back]]),
                ]
                own = [pa.repeat(batch.column(c)[n], len(columns[0])) for c in key]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], [*key, *(x.split()[0] for x in _MADE.split(", "))])

    return both.mapInArrow(task, schema)


def mutual_nearest(left: DataFrame, right: DataFrame, key: Names, id: str, vector: str, ratio: float = 0.75, *, pivots: int = 32, block: int = 512) -> DataFrame:
    """key, left_id, right_id and distance of rows that are each other's nearest within a key, the left one's second nearest clearly farther.

    ids are integers, unique on their side; of equally near ones the least id counts. Rows without a vector have
    no partner. The result is exact: with clustered vectors few blocks meet, with vectors that are all about as far from each
    other as any, all do, as matrices of `block` by `block`. Null keys are a key.
    """
    scratch = Scratch(left.sparkSession)
    sides = [df.filter(F.col(vector).isNotNull()).select(*key, F.lit(n).alias("side"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for n, df in enumerate((left, right))]
    blocks, apart = _blocks(reduce(DataFrame.union, sides), key, pivots, block, scratch)
    head = blocks.select(*key, "side", "cell", "block", "radius", "n")
    a = head.filter("side = 0").drop("side", "n")
    b = head.filter("side = 1").select(*key, *(F.col(c).alias(f"other_{c}") for c in ("cell", "block", "radius", "n")))
    met = joined(joined(a, apart.withColumnRenamed("pair", "other_cell"), [*key, "cell"]), b, [*key, "other_cell"])
    far = F.col("d") + F.col("radius") + F.col("other_radius")
    met = scratch.written(met.withColumn("far", far).withColumn("near", F.greatest(F.col("d") * 2 - far, F.lit(0.0)) - 1e-9).drop("d", "radius", "other_radius"), "block_pairs")
    place, other = [*key, "cell", "block"], [*key, "other_cell", "other_block"]
    pair = [*place, "other_cell", "other_block"]
    # Each block first meets the one of the other side that is closest to it, of two rows at least where there is one.
    first = least_of_each(met, place, 1, (F.col("other_n") < 2), F.col("far"), F.col("other_cell"), F.col("other_block")).select(*pair)
    first = scratch.written(first.union(least_of_each(met, other, 1, F.col("far"), F.col("cell"), F.col("block")).select(*pair)).distinct(), "first_pairs")
    begun = scratch.written(_compared(first, blocks, key), "first_compared")
    bound = F.when(F.col("side") == 0, F.when(F.count("*") >= 2, F.max("d"))).otherwise(F.max("d"))
    kept = least_of_each(begun, [*key, "side", "id"], 2, F.col("d"), F.col("other"))
    kept = kept.filter((F.col("side") == 0) | (F.col("d") >= 0)).groupBy(*key, "side", "id").agg(bound.alias("reach"), F.min("d").alias("least"))
    reach = kept.select(*key, "side", "id", F.when(F.col("side") == 0, F.coalesce("reach", F.lit(float("inf")))).otherwise(F.col("least")).alias("reach"))
    members = blocks.select(*key, "side", "cell", "block", F.explode("ids").alias("id"))
    limits = joined(members, reach, [*key, "side", "id"], "left").groupBy(*key, "side", "cell", "block").agg(F.max(F.coalesce("reach", F.lit(float("inf")))).alias("limit"))
    limits = scratch.written(limits, "limits")
    la = limits.filter("side = 0").select(*place, F.col("limit").alias("_a"))
    lb = limits.filter("side = 1").select(*key, F.col("cell").alias("other_cell"), F.col("block").alias("other_block"), F.col("limit").alias("_b"))
    open_ = joined(joined(met, la, place), lb, other).filter("near <= _a or near <= _b").select(*pair)
    rest = _compared(scratch.written(joined(open_, first, pair, "left_anti"), "rest_pairs"), blocks, key)
    every = scratch.written(begun.union(rest), "compared")
    two = least_of_each(every.filter("side = 0"), [*key, "id"], 2, F.col("d"), F.col("other"))
    one = F.min(F.struct("d", "other")).alias("best")
    nearest = two.groupBy(*key, "id").agg(one, F.max("d").alias("second"), F.count("*").alias("n"))
    back = every.filter("side = 1").groupBy(*key, F.col("id").alias("right_id")).agg(F.min(F.struct("d", "other")).alias("back"))
    forth = nearest.select(*key, F.col("id").alias("left_id"), F.col("best.other").alias("right_id"), F.col("best.d").alias("distance"), F.when(F.col("n") > 1, F.col("second")).alias("second"))
    clear = F.coalesce(F.col("distance") < ratio * F.col("second"), F.lit(True))
    found = written(joined(forth, back, [*key, "right_id"]).filter((F.col("back.other") == F.col("left_id")) & clear).select(*key, "left_id", "right_id", "distance"), "mutual")
    scratch.cleared()
    return found
