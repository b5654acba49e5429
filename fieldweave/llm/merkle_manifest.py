"""Merkle manifest of a table: one tree for each group of rows, one tree over the groups, proofs looked up by coordinates.

A leaf is the hash of a row's fields. The leaves of a group, in order, are level 0 of its tree; every `arity`
consecutive nodes of a level become one of the next, until one node is left, the group's subroot. Subroots are the
leaves of the tree over the groups, whose last node is the root. All nodes are one table of (tree, level, place, hash).

Levels are made and looked up in tiers of a few levels: a block of neighbouring nodes, at most `block`, gives all its
levels at once, and its top is a node of the next tier. So the number of jobs follows the number of tiers, and however
large a tree is, a node is asked for at most `block` times in its tier: what lies above is looked up once for
each block, not for each leaf. A proof takes for each level the coordinates of the siblings of the own node, explodes
them, joins the table of nodes, puts them in order and folds. All of it are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import shared

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field in a leaf: `-` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: Iterable[Column]) -> Column:
    return digest(*map(framed, fields))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by a path of (left siblings, right siblings), level by level."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "").cast("binary"), 256)


def depth_of(n: str, arity: int) -> str:
    """SQL: the levels above n leaves."""
    powers, p = [], 1
    while p < 2**62:
        powers.append(p)
        p *= arity
    return f"size(filter(array({', '.join(f'{x}L' for x in powers)}), p -> p < {n}))"


@dataclass
class Tier:
    """Units (tree, place, hash, n, depth) at the tier's first level, and the nodes of its levels."""

    low: int
    units: DataFrame
    nodes: DataFrame


@dataclass
class Manifest:
    """rows: the leaves with their tree and place. tiers and top: the trees of groups and the tree over groups. nodes: all nodes."""

    rows: DataFrame
    tiers: list[Tier]
    top: list[Tier]
    arity: int
    span: int
    scratch: shared.Scratch

    def nodes(self) -> DataFrame:
        """tree (null for the tree over the groups), level, place and hash of every node."""
        found = [(t, F.col("tree")) for t in self.tiers] + [(t, F.lit(None).cast("string")) for t in self.top]
        parts = [t.nodes.filter((F.col("level") > t.low) | (F.col("level") == 0)).select(tree.alias("tree"), "level", "place", F.lower(F.hex("hash")).alias("hash")) for t, tree in found]
        return reduce(DataFrame.union, parts)


def _placed(rows: DataFrame, order: list[Column], scratch: shared.Scratch, arity: int) -> DataFrame:
    """rows with place, their rank in their tree, n, its size, and depth, its levels; columns tree and hash are there."""
    return ranked(rows, ["tree"], order, rank="place", size="n", scratch=scratch).withColumn("depth", F.expr(depth_of("n", arity)))


def _tiers(leaves: DataFrame, scratch: shared.Scratch, arity: int, span: int) -> list[Tier]:
    """Tiers from leaves (tree, place, hash, n, depth) up to the last node of each tree."""
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    out, units = [], leaves.select("tree", "place", "hash", "n", "depth")
    for low in range(0, max(deepest, 1), span):
        block = units.groupBy("tree", "n", "depth", F.expr(f"place div {arity**span}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", F.lower(F.hex("hash")).alias("hash")))).alias("row"))
        up = f"slice(sequence(1, {span}), 1, greatest(0, least({span}, depth - {low})))"
        above = f"transform(sequence(0, (size(row) - 1) div {arity}), i -> sha2(cast(array_join(slice(row, i * {arity} + 1, {arity}), '') as binary), 256))"
        first = "array(transform(row, x -> x.hash))"
        levels = F.expr(f"aggregate({up}, {first}, (levels, l) -> concat(levels, transform(array(element_at(levels, -1)), row -> {above})))")
        rows = block.select("tree", "n", "depth", "block", F.posexplode(levels).alias("l", "row"))
        rows = rows.select("tree", "n", "depth", "block", "l", F.posexplode("row").alias("i", "hash"))
        place = F.expr(f"block * cast(power({arity}, {span} - l) as bigint) + i")
        nodes = scratch.written(rows.select("tree", (F.col("l") + low).alias("level"), place.alias("place"), F.unhex("hash").alias("hash"), "n", "depth"), "merkle_nodes")
        out.append(Tier(low, units, nodes))
        units = nodes.filter((F.col("level") == low + span) & (F.col("depth") > low + span)).select("tree", "place", "hash", "n", "depth")
    return out


def _last_nodes(tiers: list[Tier]) -> DataFrame:
    """tree and hash of the last node of each tree."""
    found = [t.nodes.filter((F.col("level") == F.col("depth")) & ((F.col("level") > t.low) | (F.col("level") == 0))) for t in tiers]
    return reduce(DataFrame.union, found).select("tree", "hash")


def _paths(tiers: list[Tier], above: DataFrame, scratch: shared.Scratch, arity: int, span: int) -> DataFrame:
    """above's (tree, path, subroot, root) with the siblings below put before its path, for each leaf (tree, place)."""
    made = None
    for tier in reversed(tiers):
        at, length = f"place div cast(power({arity}, l) as bigint)", f"ceil(n / power({arity}, {tier.low} + l))"
        mine = tier.units.select("tree", "place", "n", "depth", F.expr(f"explode_outer(slice(sequence(0, {span - 1}), 1, greatest(0, least({span}, depth - {tier.low}))))").alias("l"))
        mine = mine.select("*", F.expr(at).alias("_own"), F.expr(f"cast(least(({at} div {arity}) * {arity} + {arity}, {length}) as bigint) - 1").alias("_last"))
        asked = mine.select("tree", "place", "n", "depth", "l", "_own", F.explode_outer(F.expr(f"filter(sequence((_own div {arity}) * {arity}, _last), x -> x <> _own)")).alias("_at"))
        nodes = tier.nodes.select("tree", (F.col("level") - tier.low).alias("l"), F.col("place").alias("_at"), "hash")
        met = asked.join(nodes, ["tree", "l", "_at"], "left")
        sibling = F.when(F.col("hash").isNotNull(), F.struct("l", "_at", (F.col("_at") < F.col("_own")).alias("before"), F.lower(F.hex("hash")).alias("hash")))
        found = met.groupBy("tree", "place", "n", "depth").agg(F.array_sort(F.collect_list(sibling)).alias("found"))
        side = "array_join(transform(filter(found, x -> x.l = l and {}x.before), x -> x.hash), '')"
        steps = f"transform(slice(sequence(0, {span - 1}), 1, greatest(0, least({span}, depth - {tier.low}))), l -> struct({side.format('')} as left, {side.format('not ')} as right))"
        own = found.select("tree", "place", F.expr(f"place div {arity**span}").alias("_up"), F.expr(steps).cast(_STEPS).alias("own"))
        ends = tier.units.filter((F.col("depth") <= tier.low + span) & (F.col("place") == 0)).select("tree")
        over = above.join(ends, "tree").select("tree", F.lit(0).cast("long").alias("_up"), "path", "subroot", "root")
        if made is not None:
            over = over.union(made.select("tree", F.col("place").alias("_up"), "path", "subroot", "root"))
        made = own.join(over, ["tree", "_up"]).select("tree", "place", F.concat("own", "path").alias("path"), "subroot", "root")
        if tier.low:
            made = scratch.written(made, "merkle_paths")
    return made


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", arity: int = 2, block: int = 1024, extra: dict[str, Column] | None = None) -> Manifest:
    """The trees of docs: one for each value of `group`, null first, then by bytes; leaves in order of `order`, nulls first, then by hash.

    A leaf is the hash of the `fields`. extra: more columns to keep for each row, of docs' columns. Null and empty
    fields differ; repeated rows are equal leaves side by side; an empty table has no tree and no root. Tables on
    the way are written to the shared folder; `Manifest.scratch` deletes them. No column of docs but those named is used.
    """
    if arity < 2:
        raise ValueError("a node needs two children at least")
    span = 1
    while arity ** (span + 1) <= block:
        span += 1
    scratch = shared.Scratch(docs.sparkSession)
    kept = [F.col(order).alias("key"), F.col(group).cast("string").alias("group"), framed(F.col(group)).alias("tree"), F.unhex(leaf_of(F.col(c) for c in fields)).alias("hash")]
    leaves = scratch.written(docs.select(*kept, *(c.alias(f"extra_{name}") for name, c in (extra or {}).items())), "merkle_leaves")
    by = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("hash")]
    rows = scratch.written(_placed(leaves, by, scratch, arity), "merkle_rows")
    scratch.cleared(rows)
    tiers = _tiers(rows, scratch, arity, span)
    groups = rows.filter("place = 0").select("tree", "group")
    subroots = _last_nodes(tiers).join(groups, "tree").select(F.col("tree").alias("of"), "group", F.lit("").alias("tree"), "hash")
    top = scratch.written(_placed(subroots, [F.col("group").asc_nulls_first()], scratch, arity), "merkle_subroots")
    return Manifest(rows, tiers, [Tier(t.low, top if not t.low else t.units, t.nodes) for t in _tiers(top, scratch, arity, span)], arity, span, scratch)


def proofs(made: Manifest) -> DataFrame:
    """rows of the manifest with leaf, subroot, root and path, the siblings left and right on each level up to the root."""
    none = F.array().cast(_STEPS)
    roots = _last_nodes(made.top).select("tree", none.alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("hash")).alias("root"))
    over = _paths(made.top, roots, made.scratch, made.arity, made.span)
    groups = made.top[0].units.select("place", F.col("of"), F.lower(F.hex("hash")).alias("_subroot"))
    above = over.join(groups, "place").select(F.col("of").alias("tree"), "path", F.col("_subroot").alias("subroot"), "root")
    above = made.scratch.written(above, "merkle_above")
    paths = _paths(made.tiers, above, made.scratch, made.arity, made.span)
    rows = made.rows.drop("n", "depth").withColumn("leaf", F.lower(F.hex("hash"))).drop("hash")
    return rows.join(paths, ["tree", "place"])


def tampered(docs: DataFrame, made_id: str = "doc_id") -> tuple[Column, Column]:
    """Whether a row is tampered with (7 divides the crc32 of its id), and its leaf then: n_chars is one more, if there is one."""
    hit = F.crc32(F.col(made_id).cast("string").cast("binary")) % 7 == 0
    return hit, leaf_of(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS)


def audited(docs: DataFrame, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, some of them tampered with.

    folded_root comes from the tampered leaf, if there is one, and the original siblings. Where n_chars is null,
    tampering changes nothing and the proof holds. A row without a doc_id is never tampered with.
    """
    hit, changed = tampered(docs)
    made = manifest(docs, extra={"changed": F.when(hit, F.unhex(changed))}, **options)
    found = proofs(made)
    start = F.coalesce(F.lower(F.hex("extra_changed")), F.col("leaf"))
    found = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), fold(start, F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
