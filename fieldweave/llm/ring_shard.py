"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `virtual` points of the ring; a point owns the arc that ends at it. A document has a
place on the ring by a hash of its id and belongs to the arc there. Each shard takes so many documents
and no more; where an arc holds more than its shard still takes, its last documents in ring order go on
clockwise to the next point whose shard has room. Bounds that differ by one at most and sum to the number
of documents make the counts differ by one at most.

Only counts by cell, a fixed number, come to the driver: `virtual` x shards arcs, each in a few cells. It
follows the ring over these counts and says which ranks of each arc go to which shard. Documents then
find their range by a join with that table, whose size depends on the number of shards alone. All steps
over documents are DataFrame functions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from hashlib import md5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places on the ring are the first 15 hexadecimal digits of an MD5 digest.
RING = 16**15


def place(key: str) -> int:
    return int(md5(key.encode()).hexdigest()[:15], 16)


def place_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _constant(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def ring_points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(place, shard) of all points, clockwise."""
    return sorted((place(f"shard {s} point {v}"), s) for s in range(shards) for v in range(virtual))


def bounded_ranges(owners: list[int], loads: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): where each arc's documents go, arcs and ranks clockwise.

    First each shard takes from its own arcs as they come; what is left over goes clockwise from point to
    point, over each of which the leftovers pass in the order of their arcs, nearest first.
    """
    room, ranges, moving = list(room), [], []
    taken = [0] * len(owners)
    for arc, shard in enumerate(owners):
        n = min(loads[arc], room[shard])
        if n:
            ranges.append((arc, 0, n, shard))
        room[shard] -= n
        taken[arc] = n
    for lap in range(2):
        for arc, shard in enumerate(owners):
            while moving and room[shard]:
                origin = moving[-1]
                n = min(loads[origin] - taken[origin], room[shard])
                ranges.append((origin, taken[origin], taken[origin] + n, shard))
                taken[origin] += n
                room[shard] -= n
                if taken[origin] == loads[origin]:
                    moving.pop()
            if not lap and taken[arc] < loads[arc]:
                moving.append(arc)
    if moving:
        raise ValueError("the shards have less room than there are documents")
    return ranges


def ring_shards(docs: DataFrame, shards: int = 24, *, virtual: int = 128, cells: int = 4) -> DataFrame:
    """docs with size, text_crc32, shard, slot and home_shard (the owner of the document's arc).

    Counts of documents differ by one at most between shards; slots count each shard's documents from 0
    without a gap. Null texts count as empty, with 8 bytes. A row without a doc_id has a place by its text;
    rows that share a doc_id have neighbouring ranks in the order of their size and checksum, so that even
    many repeated rows leave the balance as it is. Columns of these names in docs are replaced.
    """
    made = ["size", "text_crc32", "shard", "slot", "home_shard"]
    spark, docs = docs.sparkSession, docs.drop(*made)
    names = docs.columns
    docs = docs.withColumnsRenamed({c: f"_own{c}" for c in names if c.startswith("_")})
    points = ring_points(shards, virtual)
    places, owners = [p for p, _ in points], [s for _, s in points]

    text = F.coalesce("text", F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))
    # A table of the ring cut into equal steps narrows each place to the few points within its step.
    n_steps = 1 << (len(places) - 1).bit_length()
    step = -(-RING // n_steps)
    first = _constant([bisect_left(places, i * step) for i in range(n_steps)], "int")
    near = max(bisect_left(places, (i + 1) * step) - bisect_left(places, i * step) for i in range(n_steps))
    ends = _constant(places + [RING] * (near + 1), "bigint")
    at = F.element_at(first, F.expr(f"int(_place div {step})") + 1)
    hops = sum((F.get(ends, F.col("_from") + i) < F.col("_place")).cast("int") for i in range(near + 1))
    # An arc begins after the point before it; its cells are equal parts of it in ring order.
    before_arc = [places[i - 1] for i in range(len(places))]
    begins, lengths = _constant(before_arc, "bigint"), _constant([(p - b) % RING or RING for p, b in zip(places, before_arc)], "bigint")

    def located(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_place", place_of(key)).withColumn("_from", at)
        rows = rows.withColumn("_arc", F.pmod(F.col("_from") + hops, F.lit(len(places)))).drop("_from")
        rows = rows.withColumn("_along", F.pmod(F.col("_place") - F.get(begins, F.col("_arc")) - 1, F.lit(RING))).withColumn("_long", F.get(lengths, F.col("_arc")))
        return rows.withColumn("_cell", F.expr(f"int(_along * {cells} div _long)")).drop("_place", "_long")

    counts = defaultdict(int)
    for arc, cell, n in located(docs.select("doc_id", "text")).groupBy("_arc", "_cell").count().collect():
        counts[arc, cell] = n
    loads = [sum(counts[arc, c] for c in range(cells)) for arc in range(len(places))]
    total = sum(loads)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    base, slots = [0] * shards, []
    for arc, begin, end, shard in sorted(bounded_ranges(owners, loads, room), key=lambda x: (x[3], x[0], x[1])):
        slots.append((arc, begin, end, shard, base[shard] - begin))
        base[shard] += end - begin
    before = {(arc, c): sum(counts[arc, x] for x in range(c)) for arc in range(len(places)) for c in range(cells)}
    plan = [(arc, c, begin, end, shard, shift, before[arc, c], owners[arc]) for arc, begin, end, shard, shift in slots for c in range(cells) if before[arc, c] < end and begin < before[arc, c] + counts[arc, c]]
    ranges = spark.createDataFrame(plan, "_arc int, _cell int, _begin long, _end long, shard int, _shift long, _before long, home_shard int")

    rest = docs.withColumn("size", F.octet_length(text).cast("long") + 8).withColumn("text_crc32", F.crc32(text))
    rest = located(rest)
    order = Window.partitionBy("_arc", "_cell").orderBy("_along", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = rest.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    # At most shards x virtual x cells ranges and one more for each point passed: a fixed bound.
    ranked = ranked.join(F.broadcast(ranges), ["_arc", "_cell"])
    rank = F.col("_rank") + F.col("_before")
    placed = ranked.filter((rank >= F.col("_begin")) & (rank < F.col("_end"))).withColumn("slot", rank + F.col("_shift"))
    return placed.select(*(F.col(own).alias(c) for own, c in zip(docs.columns, names)), *made)
