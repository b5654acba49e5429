"""Audited clips against the answer key: which window of each is scored, its scores, why others are not, and what is frozen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics, sample
from ..operators.match import event_cost
from ..sinks.lineage import settled
from . import actions, catalog

CLIP = ["clip_id"]


def selected_windows(candidates: DataFrame, tracks: DataFrame, signatures: DataFrame) -> DataFrame:
    """Of each clip's action windows the one nearest to the signature of its play, with candidate_actions and selection_cost.

    candidates: clip_id, play (the key of signatures), action_id, angle, action_order, snap_s, dead_s;
    signatures: play, duration, category, speed_profile, formation.
    """
    reliable = sample.reliable_or_all(tracks, CLIP, "track_reliable") if "track_reliable" in tracks.columns else tracks
    own = actions.action_signatures(reliable, candidates).select("action_id", "duration", "profile", "formation")
    known = signatures.select("play", "category", *[F.col(c).alias(f"_{c}") for c in ("duration", "speed_profile", "formation")])
    rows = candidates.join(own, "action_id").join(known, "play")
    cost = event_cost(
        F.col("category"), F.lit("unknown"), F.col("duration"), F.lit(1.0), expected=F.col("_duration"),
        profile=F.col("profile"), expected_profile=F.col("_speed_profile"), formation=F.col("formation"), expected_formation=F.col("_formation"),
    )
    clip = Window.partitionBy("clip_id")
    rows = rows.withColumn("selection_cost", cost).withColumn("candidate_actions", F.count("*").over(clip))
    best = rows.withColumn("_n", F.row_number().over(clip.orderBy("selection_cost", "action_order"))).filter("_n = 1")
    return best.select("clip_id", "play", "action_id", "angle", "candidate_actions", "selection_cost", "snap_s", "dead_s")


@dataclass(frozen=True)
class Evaluation:
    """results: one row for each scored clip; skipped: clip_id and reason; answers: clip_id, answer_snap and answer_rows."""

    results: DataFrame
    skipped: DataFrame
    answers: DataFrame


def scored_windows(windows: DataFrame, tracks: DataFrame, truth: DataFrame, options: metrics.EvaluationOptions = metrics.EvaluationOptions()) -> Evaluation:
    """The scores of windows (clip_id, play, snap_s, dead_s and more) of tracks against truth (play, frame_id, player_id, x, y, event)."""
    players = truth.filter("player_id is not null")
    snap = F.min(F.when(F.lower("event").isin(*actions.SNAP_EVENTS), F.col("frame_id")))
    answers = windows.select("clip_id", "play").join(players.groupBy("play").agg(snap.alias("answer_snap"), F.count("*").alias("answer_rows")), "play", "left").drop("play")
    answers = settled(answers)
    there = tracks.select("clip_id").distinct().withColumn("_there", F.lit(True))
    rows = windows.join(answers, "clip_id").join(there, "clip_id", "left")
    ready = rows.filter("_there and answer_snap is not null").withColumn("snap_frame", F.col("answer_snap"))
    labelled = players.select("play", "frame_id", F.col("player_id").alias("label"), "x", "y").join(ready.select("clip_id", "play"), "play").drop("play")
    found = metrics.evaluated(labelled, tracks, ready.select("clip_id", "snap_frame", "snap_s", "dead_s"), CLIP, options)
    a = found["alignment"].withColumnsRenamed({"median": "median_error", "p90": "p90_error", "matched": "matched_player_frames", "possible": "possible_player_frames", "coverage": "player_coverage", "offset": "snap_adjustment_s"})
    c = found["correction"].filter("matrix is not null")
    results = rows.drop("_there", "answer_snap", "answer_rows").join(a, CLIP).join(c, CLIP)
    for part in ("hota", "formation", "identity"):
        results = results.join(found[part], CLIP, "left")
    results = results.fillna(0, ["matched_assignments", "id_switches", "purity", "switches_per_100", "fragments"])
    scored = a.select("clip_id", F.lit(True).alias("_aligned")).join(c.select("clip_id", F.lit(True).alias("_held_out")), CLIP, "left")
    reason = F.when(F.col("_there").isNull(), "tracks are missing").when(F.col("answer_snap").isNull(), "the play has no snap event")
    reason = reason.when(F.col("_aligned").isNull(), "no overlapping frames in the window").when(F.col("_held_out").isNull(), "no held-out frames")
    skipped = rows.join(scored, CLIP, "left").select("clip_id", reason.alias("reason")).filter("reason is not null")
    return Evaluation(results, skipped, answers)


def evaluated_sources(t: catalog.Tables, tracks: DataFrame, options: metrics.EvaluationOptions = metrics.EvaluationOptions()) -> Evaluation:
    """All audited clips of the catalog scored, each over the window that its tracks choose now, and why others are not."""
    play = F.concat_ws(":", "external_id", F.col("play_number").cast("string"))
    truth = t["truth_tracking"].withColumn("play", F.concat_ws(":", "game_id", "play_id"))
    signatures = actions.play_signatures(truth, ["play"])
    sources = settled(catalog.audited_sources(t).withColumn("play", play))
    known = sources.join(signatures.select("play"), "play", "left_semi").select("game_id", "play_number").distinct()
    single, refused = catalog.single_play_of_clips(sources, known)
    candidates = sources.join(single.select("clip_id"), "clip_id", "left_semi")
    lost = candidates.select("clip_id").distinct().join(tracks.select("clip_id").distinct(), "clip_id", "left_anti").withColumn("reason", F.lit("tracks are missing"))
    windows = settled(selected_windows(candidates.join(lost.select("clip_id"), "clip_id", "left_anti"), tracks, settled(signatures)))
    made = scored_windows(windows, tracks, truth, options)
    return Evaluation(made.results, refused.unionByName(lost).unionByName(made.skipped), made.answers)


def summary(results: DataFrame) -> DataFrame:
    """One row: higher-order scores combined over sources, medians of the rest; sources without a value don't count for its median."""
    combined = metrics.combined(results, ["HOTA", "DetA", "AssA", "DetRe", "DetPr", "AssRe", "AssPr", "LocA"])
    middle = {"snap_median": "snap_median_error", "snap_accurate": "snap_within", "isolated_recall": "isolated_recall", "isolated_median": "isolated_median_error", "median_error": "median_source_error",
              "player_coverage": "median_source_coverage", "held_out_median": "median_refined_error", "purity": "median_purity", "switches_per_100": "median_switches_per_100"}
    recall = F.median(F.col("snap_matched") / F.greatest("snap_truth", F.lit(1))).alias("snap_recall")
    return results.agg(F.count("*").alias("sources"), recall, *[F.median(c).alias(n) for c, n in middle.items()]).join(combined)


def source_inputs(t: catalog.Tables, hashes: DataFrame) -> DataFrame:
    """What each clip's tracks were made from: its latest detections and the revision of its calibration. hashes: path and sha256."""
    latest = catalog.latest_artifacts(t, "clip_detections").select("clip_id", "path", "model_version", "config_hash").join(hashes, "path", "left")
    revision = t["calibration_keyframes"].groupBy("clip_id").agg(F.max("revision").alias("calibration_revision"))
    return latest.drop("path").join(revision, "clip_id", "full")


def frozen(found: Evaluation, inputs: DataFrame, version: int, evaluator: str, parameters: str, requested: DataFrame | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """The protocol of the clips that could be scored: windows, inputs, answers, split and the time; raises if there are none.

    requested: clip_id, only these; raises for one that is neither scored nor skipped. tracks: clip_id, path, sha256,
    artifact_id and config_hash of the tracks at this moment, which each source keeps as tracks_at_freeze.
    Beside the sources, skipped_sources() is what the protocol has on the others.
    """
    if requested is not None:
        known = found.results.select("clip_id").unionByName(found.skipped.select("clip_id"))
        catalog.unknown_requests(requested, known, "clip_id")
        found = Evaluation(found.results.join(requested.select("clip_id").distinct(), "clip_id", "left_semi"), skipped_sources(found, requested), found.answers)
    sources = found.results.select("clip_id", "play", "angle", "action_id", "candidate_actions", "selection_cost")
    if sources.isEmpty():
        reasons = "; ".join(f"{r.clip_id}: {r.reason}" for r in found.skipped.orderBy("clip_id").limit(20).collect())
        raise catalog.GateError(f"no audited source can be frozen: {reasons}")
    windows = found.results.select("clip_id", "snap_s", "dead_s")
    every = sources.select("clip_id").join(inputs, "clip_id", "left")
    kept = catalog.frozen_protocol(sources, windows, every, found.answers, version, evaluator, parameters).withColumn("frozen_at", F.current_timestamp())
    if tracks is None:
        return kept
    at = F.struct("path", "sha256", "artifact_id", "config_hash").alias("tracks_at_freeze")
    return kept.join(tracks.select("clip_id", at), "clip_id", "left")


def skipped_sources(found: Evaluation, requested: DataFrame | None = None) -> DataFrame:
    """clip_id and reason of the audited clips that are not in the protocol, of those requested."""
    return found.skipped if requested is None else found.skipped.join(requested.select("clip_id").distinct(), "clip_id", "left_semi")


def protocol_document(protocol: DataFrame, skipped: DataFrame) -> DataFrame:
    """One JSON text: the sources and what was skipped, each in the order of clips. A protocol has some dozens of either."""
    rows = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(F.col("clip_id"), *(c for c in df.columns if c != "clip_id")))).alias(name))
    both = rows(protocol, "sources").withColumn("_one", F.lit(1)).join(rows(skipped, "skipped").withColumn("_one", F.lit(1)), "_one")
    return both.select(F.to_json(F.struct("sources", "skipped")).alias("document"))


def evaluated_protocol(protocol: DataFrame, t: catalog.Tables, tracks: DataFrame, inputs: DataFrame, version: int, evaluator: str, parameters: str, *, split: str = "all", allow_drift: bool = False, options: metrics.EvaluationOptions = metrics.EvaluationOptions()) -> tuple[DataFrame, DataFrame]:
    """(results, drift) of the frozen clips over their frozen windows. Raises if one can't be scored, for other answers, and for drift that is not allowed."""
    if split not in ("all", "validation", "test"):
        raise ValueError("split is all, validation or test")
    chosen = protocol if split == "all" else protocol.filter(F.col("split") == split)
    truth = t["truth_tracking"].withColumn("play", F.concat_ws(":", "game_id", "play_id"))
    found = scored_windows(chosen.select("clip_id", "play", "action_id", "snap_s", "dead_s"), tracks, truth, options)
    current = found.answers.join(inputs, "clip_id", "left")
    drift = catalog.checked_protocol(chosen, current, version, evaluator, parameters, allow_drift)
    failed = found.skipped.limit(20).collect()
    if failed:
        raise catalog.GateError("; ".join(f"{r.clip_id}: {r.reason}" for r in failed))
    return found.results, drift
