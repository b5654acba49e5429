"""Matching, alignment and linking: candidates and costs are joins and columns, the choice among one key's candidates is a kernel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.geometry import overlap, shape_change
from ..kernels.alignment import least_cost, listed_path
from ..kernels.assignment import assign_listed
from ..kernels.linking import chains, paired_in_order
from ..sinks.lineage import settled
from .aggregate import middle_vectors, tracklet_summary
from .grouped import mapped_groups
from .joins import following_within, looking_ahead

Names = Sequence[str]


def _schema(df: DataFrame, names: Names) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def optimal_pairs(pairs: DataFrame, group: Names, frame: Names, left: str, right: str, cost: str, carry: Names = ()) -> DataFrame:
    """Of each frame's candidate pairs a cheapest one-to-one matching of as many as there can be.

    Frames of one group, such as a clip, are solved in one task call; candidates that are not listed are
    not matched. Returns group, frame, left, right, cost and the columns to carry.
    """
    names = [*group, *frame, left, right, cost, *carry]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*frame, left, right], kind="stable").reset_index(drop=True)
        number = rows.groupby(list(frame), sort=True).ngroup().to_numpy()
        lefts, rights = (pd.factorize(rows[c], sort=True)[0] for c in (left, right))
        return rows.iloc[assign_listed(number, lefts, rights, rows[cost].to_numpy(float))][names]

    return pairs.select(names).groupBy(*group).applyInPandas(solve, _schema(pairs.select(names), names))


def frame_pairs(truth: DataFrame, tracks: DataFrame, keys: Names, *, truth_xy: tuple[str, str] = ("x", "y"), track_xy: tuple[str, str] = ("field_x", "field_y"), extra: Names = ()) -> DataFrame:
    """All pairs of truth and track rows of the same keys, such as those of a frame, and their distance."""
    a = truth.select(*keys, "label", *extra, F.col(truth_xy[0]).alias("_x"), F.col(truth_xy[1]).alias("_y"))
    b = tracks.select(*keys, "track_id", *extra, F.col(track_xy[0]).alias("_u"), F.col(track_xy[1]).alias("_v"))
    return a.join(b, [*keys, *extra]).withColumn("distance", F.hypot(F.col("_x") - F.col("_u"), F.col("_y") - F.col("_v"))).drop("_x", "_y", "_u", "_v")


def match_by_team(truth: DataFrame, tracks: DataFrame, group: Names, frame: str) -> DataFrame:
    """Optimal matching of each frame; where any of its tracks has a known team, only within teams."""
    known = F.max((F.col("team").isNotNull() & (F.col("team") != "unknown")).cast("int")).over(Window.partitionBy(*group, frame))
    tracks = tracks.withColumn("_known", known)
    flags = tracks.groupBy(*group, frame).agg(F.max("_known").alias("_known"))
    side = F.when(F.col("_known") == 1, F.col("team")).otherwise(F.lit("*"))
    a = truth.join(flags, [*group, frame]).withColumn("side", side).filter("side is not null")
    b = tracks.withColumn("side", side).filter("side is not null")
    pairs = frame_pairs(a, b, [*group, frame], extra=["side"])
    return optimal_pairs(pairs, group, [frame, "side"], "label", "track_id", "distance")


STEPS = "sequence_no int, operation string, i int, j int, cost double, status string"


def aligned(left: DataFrame, right: DataFrame, costs: DataFrame, keys: Names, skip_left: float, skip_right: float, gate: float = float("inf"), sure: float = float("inf")) -> DataFrame:
    """Monotone alignment of two ordered sequences of each key.

    left and right have keys and i or j, counted from 0; costs has keys, i, j and cost of the pairs that may match. Pairs
    over the gate, or over what it costs to skip both, needn't be listed. Returns keys, sequence_no, operation, i, j,
    cost and status: candidate for matches of at most `sure`, else review. A key's rows go with its
    listed pairs, and the keys of a partition are solved one after another.
    """
    a = left.groupBy(*keys).agg(F.count("*").alias("n"))
    b = right.groupBy(*keys).agg(F.count("*").alias("m"))
    sizes = a.join(b, list(keys), "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    listed = costs.filter(F.col("cost") <= min(gate, skip_left + skip_right + 1e-9)).select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("cost").cast("double").alias("cost"))
    rows = sizes.unionByName(listed, allowMissingColumns=True)

    def solve(part: pa.Table) -> dict[str, pa.Array]:
        n, m, i, j, price = (part.column(c).to_numpy() for c in ("n", "m", "i", "j", "cost"))  # null is NaN
        known = ~np.isnan(price)
        i, j, price = listed_path(int(np.nanmax(n)), int(np.nanmax(m)), i[known].astype(int), j[known].astype(int), price[known], skip_left, skip_right)
        kind = np.array(["match", "extra", "missing"], object)[np.where(i < 0, 1, np.where(j < 0, 2, 0))]
        masked = lambda v: pa.array(v.astype(np.int32), mask=v < 0)
        status = np.where((i >= 0) & (j >= 0) & (price <= sure), "candidate", "review")
        return {"sequence_no": pa.array(np.arange(len(i), dtype=np.int32)), "operation": pa.array(kind, pa.string()), "i": masked(i), "j": masked(j), "cost": pa.array(price), "status": pa.array(status.tolist(), pa.string())}

    return mapped_groups(rows, keys, solve, STEPS)


def aligned_cost(rows: DataFrame, keys: Names, order: str, on_left: Column, value: str, scale: float, skip_left: float, skip_right: float) -> DataFrame:
    """keys and total: the cost of a cheapest monotone alignment of each key's rows of on_left with its others, whole and in order.

    A match costs the difference of values over `scale`. No pairs are made: a key takes memory in proportion
    to its rows, and time to the product of its sides.
    """
    sides = rows.select(*keys, F.col(order).alias("_order"), on_left.alias("_left"), F.col(value).cast("double").alias("_value"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_order", kind="stable")
        left, values = part["_left"].to_numpy(bool), part["_value"].to_numpy(float)
        total = least_cost(values[left], values[~left], scale, skip_left, skip_right)
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "total": [total]})

    return sides.groupBy(*keys).applyInPandas(solve, _schema(rows, keys) + ", total double")


# How long an event of each category is expected to last, in seconds.
EXPECTED_SECONDS = {"run": 6.0, "pass": 7.5, "punt": 8.0, "kickoff": 9.0, "place_kick": 5.0, "no_play": 2.0}
OTHER_SECONDS = 6.5


def event_cost(category: Column, unit_category: Column, duration: Column, confidence: Column, *, expected: Column | None = None, profile: Column | None = None, expected_profile: Column | None = None, formation: Column | None = None, expected_formation: Column | None = None) -> Column:
    """The cost of taking a unit of film for an event: category, duration, confidence and, against a known signature, shape."""
    usual = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in EXPECTED_SECONDS.items()], F.lit(OTHER_SECONDS))
    lasting = F.coalesce(expected, usual) if expected is not None else usual
    wrong = F.when((category == "unknown") | (unit_category == "unknown") | (category == unit_category), 0.0).otherwise(3.0)
    cost = wrong + F.least(F.lit(2.5), F.abs(duration - lasting) / F.greatest(lasting, F.lit(2.0))) + F.greatest(F.lit(0.0), F.lit(0.7) - confidence)
    if expected_profile is not None:
        cost = cost + F.coalesce(0.55 * arrays.shape_distance(profile, expected_profile, scaled=True), F.lit(0.0))
    if expected_formation is not None:
        cost = cost + F.coalesce(0.035 * arrays.shape_distance(formation, expected_formation), F.lit(0.0))
    return cost


def film_cost(durations: Column, expected: Column, angles_differ: Column) -> Column:
    """The cost of a group of sources for an event by its upper median duration."""
    middle = F.get(F.sort_array(durations), F.floor(F.size(durations) / 2).cast("int"))
    return F.least(F.lit(4.0), F.abs(middle - expected) / 5) + angles_differ


def group_cost(sources: Column, kind: Column) -> Column:
    """film_cost() of an array of sources (start_s, end_s, snap_s, play_end_s, angle) for a play of that kind.

    Sources with a live part count by it; where none has one, all count by their whole length. A group that
    lacks one of the two angles costs 1 more.
    """
    live = F.transform(F.filter(sources, lambda s: s["play_end_s"] > s["snap_s"]), lambda s: s["play_end_s"] - s["snap_s"])
    whole = F.transform(sources, lambda s: s["end_s"] - s["start_s"])
    both = F.exists(sources, lambda s: s["angle"] == "sideline") & F.exists(sources, lambda s: s["angle"] == "endzone")
    return film_cost(F.when(F.size(live) > 0, live).otherwise(whole), F.when(kind == "pass", 13.0).otherwise(10.0), F.when(both, 0.0).otherwise(1.0))


def signature_cost(a: str = "", b: str = "other_") -> Column:
    """The difference of two action signatures: duration, displacement, team counts, speed profile and angle."""
    c = lambda p, n: F.col(f"{p}{n}")
    relative = lambda n, least: F.abs(c(a, n) - c(b, n)) / F.greatest(c(a, n), c(b, n), F.lit(least))
    counts = F.aggregate(F.zip_with(c(a, "team_counts"), c(b, "team_counts"), lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v) / 22
    angles = (c(a, "angle") != c(b, "angle")) & (c(a, "angle") != "unknown") & (c(b, "angle") != "unknown")
    return 1.6 * relative("duration", 1.0) + relative("displacement", 2.0) + counts + arrays.profile_distance(c(a, "profile"), c(b, "profile")) + F.when(angles, 0.0).otherwise(0.35)


def paired_ahead(df: DataFrame, keys: Names, order: str, cost: Column, eligible: Column, n: int = 4, most: float = 1.55, margin: float = 0.2) -> DataFrame:
    """Rows paired with one of the n rows after them, cheapest first, only where it is clear; keys, order, partner, cost, status.

    cost and eligible are over columns of looking_ahead().
    """
    ahead = looking_ahead(df, keys, order, n).filter(eligible).select(*keys, F.col(order).alias("a"), F.col(f"other_{order}").alias("b"), cost.alias("cost"))
    positions = df.select(*keys, F.col(order).alias("a"), F.lit(None).cast(ahead.schema["b"].dataType).alias("b"), F.lit(None).cast("double").alias("cost"))
    both = positions.unionByName(ahead)
    schema = _schema(df, keys) + f", `{order}` long, partner long, cost double, status string"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        every = part[part["b"].isna()]["a"].astype(int)
        known = part.dropna(subset=["b"])
        chosen = paired_in_order(known["a"].astype(int).tolist(), known["b"].astype(int).tolist(), known["cost"].tolist(), most, margin)
        partners = {x[0] for x in chosen.values() if x[2] == "paired"}
        rows = [(a, *chosen.get(a, (-1, most, "single"))) for a in sorted(every) if a not in partners]
        out = pd.DataFrame({k: [part[k].iloc[0]] * len(rows) for k in keys})
        out[order] = [r[0] for r in rows]
        out["partner"] = pd.array([r[1] if r[1] >= 0 else None for r in rows], "Int64")
        out["cost"], out["status"] = [r[2] for r in rows], [r[3] for r in rows]
        return out

    return both.groupBy(*keys).applyInPandas(solve, schema)


def gap_candidates(tracks: DataFrame, keys: Names, *, most_gap: float, speed: float, slack: float, appearance_weight: float, appearance_gate: float, shape_weight: float = 0.0, shape_gate: float | None = None, straight: bool = False, least_rows: int = 1) -> DataFrame:
    """Pairs of tracks of which the second may continue the first after a gap, and the cost of it.

    tracks has keys, track_id, team and rows of video_timestamp, field_x, field_y, vx, vy, appearance
    (array, scaled) and, for shapes, width and height. straight: the distance without velocity may count too.
    """
    columns = ["field_x", "field_y", "vx", "vy", "width", "height"]
    ends = tracklet_summary(tracks, keys, "track_id", "video_timestamp", columns, "team").filter(F.col("n") >= least_rows)
    looks = middle_vectors(tracks, keys, "track_id", "appearance", "look")
    whole = ends.join(looks, [*keys, "track_id"], "left").withColumn("start", F.col("first.video_timestamp")).withColumn("end", F.col("last.video_timestamp"))
    whole = settled(whole)  # both sides of the join
    pairs = following_within(whole, whole, keys, "end", "start", most_gap)
    same = (F.col("l_team") == "unknown") | (F.col("r_team") == "unknown") | (F.col("l_team") == F.col("r_team"))
    go = lambda c, v: F.col(f"l_last.{c}") + F.coalesce(F.col(f"l_last.{v}"), F.lit(0.0)) * F.col("gap")
    away = F.hypot(go("field_x", "vx") - F.col("r_first.field_x"), go("field_y", "vy") - F.col("r_first.field_y"))
    if straight:
        away = F.least(away, F.hypot(F.col("l_last.field_x") - F.col("r_first.field_x"), F.col("l_last.field_y") - F.col("r_first.field_y")))
    look = F.coalesce(arrays.euclid(F.col("l_look"), F.col("r_look")), F.lit(0.0))
    pairs = pairs.filter(same).withColumn("away", away).withColumn("look", look).filter((F.col("away") <= speed * F.col("gap") + slack) & (F.col("look") <= appearance_gate))
    cost = F.col("away") + appearance_weight * F.col("look")
    if shape_gate is not None:
        shape = F.coalesce(F.hypot(shape_change(F.col("r_first.width"), F.col("l_last.width")), shape_change(F.col("r_first.height"), F.col("l_last.height"))), F.lit(0.0))
        pairs = pairs.withColumn("shape", shape).filter(F.col("shape") <= shape_gate)
        cost = cost + shape_weight * F.col("shape")
    return pairs.select(*keys, F.col("l_track_id").alias("a"), F.col("r_track_id").alias("b"), cost.alias("cost"))


def linked(tracks: DataFrame, candidates: DataFrame, keys: Names) -> DataFrame:
    """tracks with each track_id replaced by the first of its chain of links, the cheapest links first."""
    schema = _schema(tracks, keys) + ", track_id string, _root string"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        roots = chains(part["a"].tolist(), part["b"].tolist(), part["cost"].to_numpy())
        out = pd.DataFrame({k: [part[k].iloc[0]] * len(roots) for k in keys})
        out["track_id"], out["_root"] = list(roots), list(roots.values())
        return out

    roots = candidates.groupBy(*keys).applyInPandas(solve, schema)
    return tracks.join(roots, [*keys, "track_id"], "left").withColumn("track_id", F.coalesce("_root", "track_id")).drop("_root").select(tracks.columns)


# Gates and weights of short relinks and of whole-clip chains.
RELINK = {"most_gap": 0.8, "speed": 12.0, "slack": 1.5, "appearance_weight": 0.8, "appearance_gate": 2.25, "shape_weight": 0.5, "shape_gate": 1.0}
CHAIN = {"most_gap": 2.5, "speed": 11.0, "slack": 2.0, "appearance_weight": 0.5, "appearance_gate": 2.0, "straight": True, "least_rows": 3}


def relinked(tracks: DataFrame, keys: Names, **gates) -> DataFrame:
    tracks = settled(tracks)
    return linked(tracks, gap_candidates(tracks, keys, **{**RELINK, **gates}), keys)


def chained(tracks: DataFrame, keys: Names, **gates) -> DataFrame:
    tracks = settled(tracks)
    return linked(tracks, gap_candidates(tracks, keys, **{**CHAIN, **gates}), keys)


def fused(primary: DataFrame, other: DataFrame, keys: Names, frame: str, near: float = 3.0) -> DataFrame:
    """Two sources of one event as one: matched rows within reach are averaged, the primary's rest stays, and other rows count only in frames without the primary."""
    group = [*keys, frame]
    a = primary.select(*group, F.col("track_id").alias("label"), F.col("x").alias("px"), F.col("y").alias("py"))
    b = other.select(*group, F.col("track_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = a.join(b, group).withColumn("distance", F.hypot(F.col("px") - F.col("ox"), F.col("py") - F.col("oy")))
    found = optimal_pairs(pairs, keys, [frame], "label", "track_id", "distance").filter(F.col("distance") <= near)
    mate = found.join(b, [*group, "track_id"]).select(*group, "label", "ox", "oy")
    own = a.join(mate, [*group, "label"], "left").select(*group, F.col("label").alias("track_id"), F.coalesce((F.col("px") + F.col("ox")) / 2, "px").alias("x"), F.coalesce((F.col("py") + F.col("oy")) / 2, "py").alias("y"), F.when(F.col("ox").isNull(), 1).otherwise(2).alias("sources"))
    alone = other.join(primary.select(*group).distinct(), group, "left_anti").select(*group, "track_id", "x", "y", F.lit(1).alias("sources"))
    return own.unionByName(alone)


def box_pairs(a: DataFrame, b: DataFrame, keys: Names, gate: float = 1.4) -> DataFrame:
    """Pairs of boxes of the same keys by one minus overlap plus the distance of centres over the first's diagonal."""
    box = ["x1", "y1", "x2", "y2"]
    left = a.select(*keys, F.col("id").alias("left"), *[F.col(c).alias(f"l{c}") for c in box])
    right = b.select(*keys, F.col("id").alias("right"), *[F.col(c).alias(f"r{c}") for c in box])
    l, r = [F.col(f"l{c}") for c in box], [F.col(f"r{c}") for c in box]
    away = F.hypot((l[0] + l[2] - r[0] - r[2]) / 2, (l[1] + l[3] - r[1] - r[3]) / 2) / F.greatest(F.hypot(l[2] - l[0], l[3] - l[1]), F.lit(1.0))
    return left.join(right, list(keys)).withColumn("cost", 1 - overlap(l, r) + away).filter(F.col("cost") <= gate).select(*keys, "left", "right", "cost")
