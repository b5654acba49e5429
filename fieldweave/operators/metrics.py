"""Scores of tracks against truth: trajectory errors, identity, higher-order tracking accuracy, formation accuracy, grid alignment."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import LENGTH, WIDTH, flipped, gaussian_similarity, perspective
from ..kernels import projective
from ..kernels.assignment import assign_listed
from ..sinks.lineage import settled
from . import aggregate, joins
from .grouped import dealt
from .match import frame_pairs, match_by_team, optimal_pairs

Names = Sequence[str]
EPS = float(np.finfo("float").eps)
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]
FIELD = np.array([LENGTH, WIDTH])


def trajectory_errors(truth: DataFrame, tracks: DataFrame, keys: Names, frame: str = "frame_id", near: float = 3.0, by_team: bool = False) -> DataFrame:
    """Median and 90th percentile of matched distances, coverage and the share within reach; truth in frames without tracks counts as missed."""
    if by_team:
        found = match_by_team(truth, tracks, keys, frame)
    else:
        found = optimal_pairs(frame_pairs(truth, tracks, [*keys, frame]), keys, [frame], "label", "track_id", "distance")
    whole = truth.select(*keys, frame, "label").join(found.select(*keys, frame, "label", F.col("distance").alias("error")), [*keys, frame, "label"], "left")
    return aggregate.error_summary(whole, keys, "error", near)


def identity_metrics(matched: DataFrame, keys: Names, at: str) -> DataFrame:
    """Purity of tracks, switches of labels between tracks, and tracks for each label, of matched rows (track_id, label, distance)."""
    n = matched.groupBy(*keys).agg(F.count("*").alias("matched_assignments"), F.median("distance").alias("median_assignment_error"))
    w = Window.partitionBy(*keys, "label").orderBy(at, "track_id")
    changed = F.coalesce((F.col("track_id") != F.lag("track_id").over(w)).cast("long"), F.lit(0))
    switched = matched.withColumn("_c", changed).groupBy(*keys).agg(F.sum("_c").alias("id_switches"))
    out = n.join(aggregate.purity(matched, keys, "track_id", "label"), list(keys)).join(switched, list(keys)).join(aggregate.fragments(matched, keys, "track_id", "label"), list(keys))
    return out.withColumn("switches_per_100", 100 * F.col("id_switches") / F.col("matched_assignments"))


def soft_alignment(truth: DataFrame, tracks: DataFrame, keys: Names, frame: str, tau: float) -> tuple[DataFrame, DataFrame]:
    """Similarities of all pairs of each frame, and how much each label and track go together over all frames (0 to 1)."""
    pairs = frame_pairs(truth, tracks, [*keys, frame]).withColumn("sim", gaussian_similarity(F.col("distance"), tau))
    rows, columns = F.sum("sim").over(Window.partitionBy(*keys, frame, "label")), F.sum("sim").over(Window.partitionBy(*keys, frame, "track_id"))
    pairs = pairs.withColumn("_d", rows + columns - F.col("sim")).withColumn("ratio", F.when(F.col("_d") > EPS, F.col("sim") / F.col("_d")).otherwise(0.0)).drop("_d")
    together = pairs.groupBy(*keys, "label", "track_id").agg(F.sum("ratio").alias("potential"))
    gt = truth.groupBy(*keys, "label").agg(F.count("*").alias("gt_n"))
    pr = tracks.groupBy(*keys, "track_id").agg(F.count("*").alias("pr_n"))
    whole = together.join(gt, [*keys, "label"]).join(pr, [*keys, "track_id"])
    score = F.col("potential") / F.greatest(F.col("gt_n") + F.col("pr_n") - F.col("potential"), F.lit(1e-10))
    return pairs, whole.withColumn("alignment", score)


HOTA = ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA"]


def _thresholds(t: pd.DataFrame, p: pd.DataFrame, frame: str, tau: float) -> np.ndarray:
    """The means of HOTA's scores over all thresholds for one key's truth and tracks, neither of them empty."""
    (label, labels), (track, tracks) = pd.factorize(t["label"], sort=True), pd.factorize(p["track_id"], sort=True)
    gt_n, pr_n = np.bincount(label, minlength=len(labels)), np.bincount(track, minlength=len(tracks))
    a = pd.DataFrame({"f": t[frame], "label": label, "x": t["x"], "y": t["y"]}).dropna(subset=["f"])
    b = pd.DataFrame({"f": p[frame], "track": track, "u": p["field_x"], "v": p["field_y"]}).dropna(subset=["f"])
    pairs = a.merge(b, on="f").sort_values(["f", "label", "track"], kind="stable")
    number, l, r = pd.factorize(pairs["f"])[0], pairs["label"].to_numpy(), pairs["track"].to_numpy()
    away = np.hypot(pairs["x"] - pairs["u"], pairs["y"] - pairs["v"]).to_numpy(float)
    sim = np.exp(np.log(0.05) * away * away / (tau * tau))
    summed = lambda cell: np.bincount(cell, np.nan_to_num(sim))[cell]
    whole = summed(number * len(labels) + l) + summed(number * len(tracks) + r) - sim
    ratio = np.where(whole > EPS, sim / np.where(whole > EPS, whole, 1.0), 0.0)
    cells, cell = np.unique(l * len(tracks) + r, return_inverse=True)
    potential, both = np.bincount(cell, ratio, len(cells)), (gt_n[cells // len(tracks)], pr_n[cells % len(tracks)])
    alignment = potential / np.maximum(both[0] + both[1] - potential, 1e-10)
    chosen = assign_listed(number, l, r, -alignment[cell] * sim)
    cell, sim, scores = cell[chosen], sim[chosen], []
    for alpha in ALPHAS:
        met = sim >= alpha - EPS
        m, tp = np.bincount(cell[met], minlength=len(cells)).astype(float), int(met.sum())
        ass, re, pr = (float((m * m / np.maximum(n, 1)).sum()) / max(tp, 1) for n in (both[0] + both[1] - m, *both))
        det = tp / max(len(t) + len(p) - tp, 1)
        scores.append((np.sqrt(det * ass), det, ass, tp / max(len(t), 1), tp / max(len(p), 1), re, pr, max(float(sim[met].sum()), 1e-10) / max(tp, 1e-10)))
    return np.mean(scores, axis=0)


def hota(truth: DataFrame, tracks: DataFrame, keys: Names, frame: str = "frame_id", tau: float = 2.5) -> DataFrame:
    """HOTA, DetA, AssA, DetRe, DetPr, AssRe, AssPr and LocA of each key, as means over 19 thresholds, and counts.

    truth has label and x, y; tracks has track_id and field_x, field_y, one row for each and frame. Keys that
    only one side has score 0. Frames are matched over all their pairs; a matched pair counts at the
    thresholds that its similarity reaches. A key's rows, those of one clip, meet in one task, and pairs are made there alone.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    keys = list(keys)
    a, b = truth.select(*keys, frame, "label", "x", "y"), tracks.select(*keys, frame, "track_id", "field_x", "field_y")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema if f.name in keys), "gt_dets long", "pr_dets long", *(f"{c} double" for c in HOTA)])

    def score(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = _thresholds(t, p, frame, tau) if len(t) and len(p) else np.zeros(len(HOTA))
        first = t if len(t) else p
        return pd.DataFrame([(*(first[k].iloc[0] for k in keys), len(t), len(p), *found)], columns=[*keys, "gt_dets", "pr_dets", *HOTA])

    return dealt(a, keys).groupBy(*keys).cogroup(dealt(b, keys).groupBy(*keys)).applyInPandas(score, schema)


def combined(scores: DataFrame, metrics: Names) -> DataFrame:
    """The plain mean of each metric over keys with truth, how many there are, and summed counts."""
    return scores.filter("gt_dets > 0").agg(*[F.avg(x).alias(x) for x in metrics], F.count("*").alias("sequences"), F.sum("gt_dets").alias("gt_dets"), F.sum("pr_dets").alias("pr_dets"))


@dataclass(frozen=True)
class EvaluationOptions:
    """Fixed values of the evaluator: grids, gates and windows."""

    confidence: float = 0.55
    coarse: tuple[float, float, float] = (-1.5, 1.5, 0.2)
    coverage_weight: float = 2.0
    fine: tuple[float, float] = (0.2, 0.05)
    gates: tuple[float, ...] = (15.0, 10.0, 7.0)
    reach: float = 2.0
    least_pairs: int = 30
    identity_gate: float = 8.0
    tau: float = 2.5
    window: float = 0.5
    accurate: float = 1.0
    isolation: float = 3.0


def _on_grid(tracks: DataFrame, grid: DataFrame, clock: DataFrame, keys: Names) -> DataFrame:
    """tracks once for each grid point (g, offset, flip_x, flip_y) of their key, on the truth's clock and field."""
    moved = tracks.join(grid, list(keys)).join(clock, list(keys))
    moved = joins.at_frame(moved, "frame_id", F.col("snap_frame"), F.col("video_timestamp"), F.col("snap_s"), F.col("offset"))
    x, y = flipped(F.col("field_x"), F.col("field_y"), F.col("flip_x"), F.col("flip_y"))
    return moved.withColumn("field_x", x).withColumn("field_y", y).withColumn("at", F.col("video_timestamp"))


@dataclass(frozen=True)
class _Clip:
    """One clip's truth by frame and tracks by time, as plain arrays for the search of a grid."""

    answers: dict[int, np.ndarray]
    times: list[tuple[float, np.ndarray]]
    snap_frame: int
    snap_s: float

    def errors(self, points: list[tuple[float, bool, bool]]) -> list[tuple[np.ndarray, int]]:
        """Of each grid point (offset, flip_x, flip_y) the distances of matched places, and how many truth has in the frames met."""
        entries, possible = [], []
        moved = {flips: [np.where(flips, FIELD - p, p) for _, p in self.times] for flips in {x[1:] for x in points}}
        for g, (offset, *flips) in enumerate(points):
            possible.append(0)
            for i, (at, _) in enumerate(self.times):
                actual = self.answers.get(self.snap_frame + round((at - self.snap_s + offset) * 10))
                if actual is not None:
                    possible[-1] += len(actual)
                    entries.append((g, np.linalg.norm(actual[:, None] - moved[tuple(flips)][i][None], axis=2)))
        if not entries:
            return [(np.empty(0), 0) for _ in points]
        n = np.array([d.size for _, d in entries])
        frame, cost = np.repeat(np.arange(len(entries)), n), np.concatenate([d.ravel() for _, d in entries])
        left, right = (np.concatenate([x.ravel() for x in side]) for side in zip(*(np.indices(d.shape) for _, d in entries)))
        chosen = assign_listed(frame, left, right, cost)
        owner = np.array([g for g, _ in entries])[frame[chosen]]
        cuts = np.searchsorted(owner, np.arange(len(points) + 1))
        return [(cost[chosen[a:b]], p) for a, b, p in zip(cuts, cuts[1:], possible)]


def grid_aligned(truth: DataFrame, tracks: DataFrame, clock: DataFrame, keys: Names, options: EvaluationOptions = EvaluationOptions()) -> DataFrame:
    """The offset and flips of each key at which tracks lie nearest to truth: a coarse grid with a penalty for coverage, then fine offsets by the median alone.

    clock has keys, snap_frame and snap_s. A key's rows, those of one clip, meet in one task, where the grid
    is searched over arrays: its points make no rows. Keys of which no frame is covered are left out.
    """
    keys = list(keys)
    low, high, step = options.coarse
    half, by = options.fine
    coarse = [(float(o), fx, fy) for o in np.arange(low, high + 1e-3, step) for fx, fy in itertools.product((False, True), repeat=2)]
    a = truth.select(*keys, "frame_id", "x", "y")
    b = tracks.select(*keys, "video_timestamp", "field_x", "field_y").join(clock.select(*keys, "snap_frame", "snap_s"), keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema if f.name in keys)
    schema += ", median double, offset double, flip_x boolean, flip_y boolean, p90 double, matched long, possible long, coverage double"

    def search(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")})
        if not len(t) or not len(p):
            return none
        answers = {int(f): g[["x", "y"]].to_numpy(float) for f, g in t.groupby("frame_id")}
        times = [(float(at), g[["field_x", "field_y"]].to_numpy(float)) for at, g in p.groupby("video_timestamp")]
        clip = _Clip(answers, times, int(p["snap_frame"].iloc[0]), float(p["snap_s"].iloc[0]))
        found = [(float(np.median(e)) + options.coverage_weight * (1 - len(e) / max(n, 1)), *x) for x, (e, n) in zip(coarse, clip.errors(coarse)) if len(e)]
        if not found:
            return none
        _, offset, *flips = min(found)
        fine = [(float(o), *flips) for o in np.arange(offset - half, offset + half + 1e-3, by)]
        fitted = [(float(np.median(e)), *x, float(np.percentile(e, 90)), len(e), n) for x, (e, n) in zip(fine, clip.errors(fine)) if len(e)]
        best = min(fitted)
        return pd.DataFrame([(*(t[k].iloc[0] for k in keys), *best, best[-2] / max(best[-1], 1))], columns=none.columns)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(search, schema)


def refined_maps(truth: DataFrame, moved: DataFrame, keys: Names, options: EvaluationOptions = EvaluationOptions()) -> DataFrame:
    """A projective correction of each key, fitted on its even frames within ever smaller gates, and its errors on the odd ones.

    Even and odd count all times of the key's tracks. Fitting ends before a gate within which there are too
    few pairs, or for which there is no map; the correction is then the last one, at first none at all. Keys
    without an odd time that truth covers have a null matrix.
    """
    a = truth.select(*keys, "frame_id", "label", "x", "y")
    b = moved.select(*keys, "at", "frame_id", "track_id", "field_x", "field_y")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in a.schema if f.name in keys)
    schema += ", matrix array<array<double>>, inliers int, pairs int, held_out int, held_out_coverage double, held_out_median double, held_out_p90 double"

    def solve(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        answers = {f: g[["x", "y"]].to_numpy(float) for f, g in t.groupby("frame_id")}
        times = [(i % 2, g[["field_x", "field_y"]].to_numpy(float), answers.get(g["frame_id"].iloc[0])) for i, (_, g) in enumerate(p.groupby("at"))]

        def matched(odd: int, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places, where they should be, and how far off they are, of all pairs of these times."""
            found = [(pts, actual, np.linalg.norm(actual[:, None] - projective.apply(matrix, pts)[None], axis=2)) for which, pts, actual in times if which == odd and actual is not None]
            if not found:
                return np.empty((0, 2)), np.empty((0, 2)), np.empty(0)
            n, m = np.array([len(x[1]) for x in found]), np.array([len(x[0]) for x in found])
            frame = np.repeat(np.arange(len(found)), n * m)
            left, right = (np.concatenate([x.ravel() for x in side]) for side in zip(*(np.indices(x[2].shape) for x in found)))
            off = np.concatenate([x[2].ravel() for x in found])
            chosen = assign_listed(frame, left, right, off)
            f = frame[chosen]
            source, target = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            return source[(np.cumsum(m) - m)[f] + right[chosen]], target[(np.cumsum(n) - n)[f] + left[chosen]], off[chosen]

        matrix, inliers, pairs = np.eye(3), 0, 0
        for gate in options.gates:
            source, target, off = matched(0, matrix)
            near = off < gate
            pairs = int(near.sum())
            if pairs < options.least_pairs:
                break
            fitted, inside = projective.robust_fit(source[near], target[near], options.reach)
            if fitted is None:
                break
            matrix, inliers = fitted, int(inside.sum())
        _, _, off = matched(1, matrix)
        possible = sum(len(actual) for which, _, actual in times if which and actual is not None)
        first = t if len(t) else p
        held = (float(np.median(off)), float(np.percentile(off, 90))) if len(off) else (None, None)
        return pd.DataFrame([(*(first[k].iloc[0] for k in keys), matrix.tolist() if len(off) else None, inliers, pairs, len(off), len(off) / max(possible, 1), *held)], columns=[*keys, "matrix", "inliers", "pairs", "held_out", "held_out_coverage", "held_out_median", "held_out_p90"])

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(solve, schema)


def five_unit_correction(truth: DataFrame, tracks: DataFrame, clock: DataFrame, keys: Names, step: float = 5.0, most: float = 50.0) -> DataFrame:
    """shift_x: by how many whole steps the tracks' middle at the snap lies off the truth's, at most `most`; 0 where either is missing.

    clock: keys, snap_frame, snap_s, offset and flip_x.
    """
    keys = list(keys)
    at_snap = tracks.join(clock, keys).withColumn("_gap", F.abs(F.col("video_timestamp") - (F.col("snap_s") - F.col("offset"))))
    nearest = at_snap.groupBy(*keys).agg(F.min_by("video_timestamp", F.struct("_gap", "video_timestamp")).alias("_t"))
    x, _ = flipped(F.col("field_x"), F.lit(0.0), F.col("flip_x"), F.lit(False))
    mine = at_snap.join(nearest, keys).filter("video_timestamp = _t").groupBy(*keys).agg(F.median(x).alias("_mine"))
    actual = truth.join(clock.select(*keys, "snap_frame"), keys).filter("frame_id = snap_frame").groupBy(*keys).agg(F.median("x").alias("_actual"))
    shift = F.rint((F.col("_actual") - F.col("_mine")) / step) * step
    found = clock.select(*keys).join(mine, keys, "left").join(actual, keys, "left")
    bounded = F.greatest(F.lit(-most), F.least(F.lit(most), shift))
    return found.select(*keys, F.when(shift.isNull(), 0.0).otherwise(bounded).alias("shift_x"))


def corrected(moved: DataFrame, maps: DataFrame, keys: Names) -> DataFrame:
    x, y = perspective(F.col("matrix"), F.col("field_x"), F.col("field_y"))
    return moved.join(maps.select(*keys, "matrix").filter("matrix is not null"), list(keys)).withColumn("_x", x).withColumn("_y", y).drop("field_x", "field_y", "matrix").withColumnsRenamed({"_x": "field_x", "_y": "field_y"})


def formation_accuracy(truth: DataFrame, moved: DataFrame, clock: DataFrame, keys: Names, options: EvaluationOptions = EvaluationOptions()) -> DataFrame:
    """How well places near the snap, and isolated rows, are matched. Recall has no gate of distance: it counts any matched row."""
    keys = list(keys)
    covered = moved.select(*keys, "frame_id").distinct().join(truth.select(*keys, "frame_id").distinct(), [*keys, "frame_id"]).join(clock, keys)
    reference = covered.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("frame_id") == F.col("snap_frame"), F.col("frame_id"))), F.min("frame_id")).alias("reference"), F.max(F.col("frame_id") == F.col("snap_frame")).alias("snap_covered"))
    spaced = joins.nearest_neighbour(truth, [*keys, "frame_id"], "label", "x", "y")
    times = moved.select(*keys, "frame_id", "at").distinct()
    found = optimal_pairs(truth.select(*keys, "frame_id", "label", F.col("x").alias("_x"), F.col("y").alias("_y")).join(moved, [*keys, "frame_id"]).withColumn("distance", F.hypot(F.col("_x") - F.col("field_x"), F.col("_y") - F.col("field_y"))), keys, ["at"], "label", "track_id", "distance")
    rows = spaced.join(times, [*keys, "frame_id"]).join(found.select(*keys, "at", "label", "distance"), [*keys, "at", "label"], "left").join(reference, keys)
    snap = F.abs(F.col("frame_id") - F.col("reference")) <= round(options.window * 10)
    alone = F.coalesce(F.col("spacing") >= options.isolation, F.lit(True))
    error = F.when(snap, F.col("distance"))
    return rows.groupBy(*keys, "reference", "snap_covered").agg(
        F.sum(snap.cast("int")).alias("snap_truth"), F.count(error).alias("snap_matched"), F.median(error).alias("snap_median"), F.percentile(error, 0.9).alias("snap_p90"),
        F.avg((error <= options.accurate).cast("double")).alias("snap_accurate"), (F.count(F.when(alone, F.col("distance"))) / F.greatest(F.sum(alone.cast("int")), F.lit(1))).alias("isolated_recall"), F.median(F.when(alone, F.col("distance"))).alias("isolated_median"),
    )


def evaluated(truth: DataFrame, tracks: DataFrame, windows: DataFrame, keys: Names, options: EvaluationOptions = EvaluationOptions()) -> dict[str, DataFrame]:
    """All scores of each key: alignment, correction, hota, formation and identity. windows has keys, snap_frame, snap_s and dead_s."""
    from .sample import reliable_or_all

    keys = list(keys)
    clock = windows.select(*keys, "snap_frame", "snap_s")
    inside = tracks.join(windows.select(*keys, F.col("snap_s").alias("_a"), F.col("dead_s").alias("_b")), keys).filter(F.col("video_timestamp").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    spatial = inside.filter(F.col("confidence") >= options.confidence) if "confidence" in tracks.columns else inside
    identity = reliable_or_all(inside, keys, "track_reliable") if "track_reliable" in tracks.columns else inside
    # One row for each key; several scores read these.
    alignment = settled(grid_aligned(truth, spatial, clock, keys, options))
    point = alignment.select(*keys, F.lit(0).alias("g"), "offset", "flip_x", "flip_y")
    maps = settled(refined_maps(truth, _on_grid(spatial, point, clock, keys), keys, options))
    moved = settled(corrected(_on_grid(identity, point, clock, keys), maps, keys))
    pairs = truth.select(*keys, "frame_id", "label", F.col("x").alias("_x"), F.col("y").alias("_y")).join(moved, [*keys, "frame_id"]).withColumn("distance", F.hypot(F.col("_x") - F.col("field_x"), F.col("_y") - F.col("field_y")))
    matched = optimal_pairs(pairs, keys, ["at"], "label", "track_id", "distance").filter(F.col("distance") <= options.identity_gate)
    last = moved.withColumn("_n", F.max("at").over(Window.partitionBy(*keys, "frame_id"))).filter("at = _n").drop("_n")
    covered = truth.join(last.select(*keys, "frame_id").distinct(), [*keys, "frame_id"])
    scores = hota(covered, last.join(covered.select(*keys, "frame_id").distinct(), [*keys, "frame_id"]), keys, "frame_id", options.tau)
    parts = {"hota": scores, "formation": formation_accuracy(truth, moved, clock, keys, options), "identity": identity_metrics(matched, keys, "at")}
    return {"alignment": alignment, "correction": maps, **{k: settled(v) for k, v in parts.items()}}
