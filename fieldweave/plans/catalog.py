"""Queries over the catalog's tables: lists, details, work queues, reports, gates and protocols. Each takes and gives DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import present
from ..functions.text import trailing_number
from ..operators import joins, sample
from ..operators.aggregate import count_where, rate
from ..operators.match import aligned, event_cost
from ..operators.sequence import latest
from ..schemas import conformed
from ..sinks.tables import replaced_groups

Tables = Mapping[str, DataFrame]


def games(t: Tables) -> DataFrame:
    """Games with the number of their eligible plays, the newest first."""
    n = t["plays"].filter("eligible").groupBy("game_id").agg(F.count("*").alias("eligible_plays"))
    return t["games"].join(n, "game_id", "left").fillna(0, ["eligible_plays"]).orderBy(F.col("season").desc(), F.col("week").desc(), "game_id")


# What a play without a report of its own is told to lack.
NOT_ALIGNED = "Film segmentation and play alignment have not been run for this play."
REJECTED = "No acceptable sideline/end-zone clip pair was found for this play."
AWAITING = "The play is aligned, but tracking and quality evaluation have not been run."


def processing_status(alignment: Column, quality: Column) -> Column:
    return F.when(alignment.isNull(), "not_aligned").when(alignment == "rejected", "alignment_rejected").otherwise(F.coalesce(quality, F.lit("awaiting_reconstruction")))


def processing_reasons(status: Column, reasons: Column) -> Column:
    """The report's own reasons, or why there is no report."""
    own = F.coalesce(reasons, F.array().cast("array<string>"))
    rejected = F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(REJECTED)))
    out = F.when(status == "not_aligned", F.array(F.lit(NOT_ALIGNED))).when(status == "alignment_rejected", rejected)
    return out.when(status == "awaiting_reconstruction", F.array(F.lit(AWAITING))).otherwise(own)


def plays(t: Tables, game_id: str) -> DataFrame:
    """A game's eligible plays with alignment, sources, quality, audit, status and reasons."""
    sources = t["play_sources"].select("play_id", "source_order", "angle", "clip_id").join(t["clips"].select("clip_id", "start_s", "end_s", "snap_s", "play_end_s", "confidence"), "clip_id")
    source = F.struct("source_order", "angle", "clip_id", "start_s", "end_s", "snap_s", "play_end_s", "confidence")
    listed = sources.groupBy("play_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    a = t["play_alignments"].select("play_id", "game_id", "ordinal", "score", F.col("status").alias("alignment_status"))
    q = t["quality_reports"].select("play_id", F.col("status").alias("quality_status"), "reasons_json", "metrics_json")
    rows = t["plays"].filter((F.col("game_id") == game_id) & F.col("eligible")).join(a, ["game_id", "ordinal"], "left")
    rows = rows.join(q, "play_id", "left").join(t["audits"], "play_id", "left").join(listed, "play_id", "left")
    rows = rows.withColumn("sources", F.coalesce("sources", F.array().cast(listed.schema["sources"].dataType))).withColumn("selected", F.coalesce("selected", F.lit(False)))
    rows = rows.withColumn("processing_status", processing_status(F.col("alignment_status"), F.col("quality_status")))
    reasons = F.from_json(F.coalesce("reasons_json", F.lit("[]")), "array<string>")
    metrics = F.from_json(F.coalesce("metrics_json", F.lit("{}")), "map<string, double>")
    return rows.withColumn("reasons", processing_reasons(F.col("processing_status"), reasons)).withColumn("metrics", metrics).orderBy("ordinal")


def source_facts(snap: Column, end: Column, confidence: Column) -> dict[str, Column]:
    """Aggregates over a play's sources that its review priority follows from."""
    lasting = F.when(snap.isNotNull() & end.isNotNull(), end - snap)
    return {
        "n": F.count(F.lit(1)), "untimed": count_where(snap.isNull() | end.isNull()), "least": F.min(F.coalesce(confidence, F.lit(0.0))),
        "timed": F.count(lasting), "shortest": F.min(lasting), "longest": F.max(lasting),
    }


def listed_facts(sources: Column) -> dict[str, Column]:
    """The same of an array of sources with snap_s, play_end_s and confidence."""
    lasting = F.transform(
        F.filter(sources, lambda s: s["snap_s"].isNotNull() & s["play_end_s"].isNotNull()), lambda s: s["play_end_s"] - s["snap_s"]
    )
    return {
        "n": F.size(sources), "untimed": F.size(F.filter(sources, lambda s: s["snap_s"].isNull() | s["play_end_s"].isNull())),
        "least": F.array_min(F.transform(sources, lambda s: F.coalesce(s["confidence"], F.lit(0.0)))),
        "timed": F.size(lasting), "shortest": F.array_min(lasting), "longest": F.array_max(lasting),
    }


def review_priority(facts: Mapping[str, Column], ordinal: Column) -> tuple[Column, Column, Column]:
    """(score, number of reasons, reasons) for reviewing a play, from facts about its sources; a play without sources has n of 0 and nulls."""
    # The texts of the reasons.
    n, untimed, least = facts["n"], F.coalesce(facts["untimed"], F.lit(0)), facts["least"]
    ratio = F.when((facts["timed"] == 2) & (facts["shortest"] > 0), facts["longest"] / F.nullif(facts["shortest"], F.lit(0.0)))
    counted = F.concat(n.cast("string"), F.when(n == 1, " source").otherwise(" sources"), F.lit("; expected 2"))
    unsure = F.concat(F.lit("low source confidence ("), F.format_string("%.2f", least), F.lit(")"))
    apart = F.concat(F.lit("angle timings disagree ("), F.format_string("%.1f", ratio), F.lit("×)"))
    tests = [
        (n != 2, F.lit(50.0), counted),
        (untimed > 0, 45.0 + 5 * untimed, F.lit("missing action timing")),
        (F.coalesce(least < 0.5, F.lit(False)), 20 + 40 * (0.5 - least), unsure),
        (F.coalesce(ratio >= 2, F.lit(False)), 30 + F.least(F.lit(30.0), 10 * (ratio - 2)), apart),
    ]
    score = sum((F.when(test, value).otherwise(0.0) for test, value, _ in tests), F.lit(0.0))
    found = sum((test.cast("int") for test, _, _ in tests), F.lit(0))
    checkpoint = (found == 0) & (F.coalesce(ordinal, F.lit(0)) % 12 == 0)
    reasons = F.when(checkpoint, F.array(F.lit("alignment checkpoint"))).otherwise(present(*[F.when(test, reason) for test, _, reason in tests]))
    return score + F.when(checkpoint, 10.0).otherwise(0.0), found + checkpoint.cast("int"), reasons


def audit_queue(t: Tables, game_id: str, limit: int = 40) -> DataFrame:
    """Aligned plays not yet audited that have a reason to be reviewed, the most urgent first."""
    rows = plays(t, game_id).filter("alignment_status is not null and mapping_correct is null")
    score, _, reasons = review_priority(listed_facts(F.col("sources")), F.col("ordinal"))
    urgent = sample.top(rows.withColumn("priority", score).filter("priority > 0"), limit, F.col("priority").desc(), F.col("ordinal"))
    return urgent.withColumn("reasons", reasons)


def shots(t: Tables, game_id: str) -> DataFrame:
    """Clips with the numbers of their actions and keyframes, each counted before they are joined."""
    a = t["action_windows"].groupBy("clip_id").agg(F.count("*").alias("actions"))
    k = t["calibration_keyframes"].groupBy("clip_id").agg(F.count("*").alias("keyframes"))
    return t["clips"].filter(F.col("game_id") == game_id).join(a, "clip_id", "left").join(k, "clip_id", "left").fillna(0, ["actions", "keyframes"]).orderBy("start_s")


def play_detail(t: Tables, play_id: str) -> DataFrame:
    """One play with both angles' clips, quality and game."""
    clip = lambda side: t["clips"].select(F.col("clip_id").alias(f"{side}_clip_id"), *[F.col(c).alias(f"{side}_{c}") for c in ("start_s", "end_s", "snap_s", "play_end_s")])
    rows = t["play_alignments"].filter(F.col("play_id") == play_id).join(t["plays"].drop("play_type"), ["game_id", "ordinal"])
    rows = rows.join(clip("sideline"), "sideline_clip_id", "left").join(clip("endzone"), "endzone_clip_id", "left")
    return rows.join(t["quality_reports"].select("play_id", F.col("status").alias("quality_status")), "play_id", "left").join(t["games"].select("game_id", "season", "week"), "game_id")


def latest_artifacts(t: Tables, kind: str) -> DataFrame:
    return latest(t["artifacts"].filter(F.col("kind") == kind), ["clip_id"], F.col("artifact_id").desc())


def audited_sources(t: Tables) -> DataFrame:
    """Clips of plays whose mapping and sources were found right, with each of their action windows and the play in the answer key."""
    good = t["audits"].filter("mapping_correct and sources_correct").select("play_id")
    rows = t["play_sources"].select("play_id", "clip_id").join(good, "play_id").join(t["play_alignments"].select("play_id", "game_id", "ordinal"), "play_id")
    rows = rows.join(t["clips"].select("clip_id", "angle"), "clip_id").join(t["plays"].select("game_id", "ordinal", "source_row_id"), ["game_id", "ordinal"])
    rows = rows.join(t["action_windows"].select("clip_id", "action_id", "action_order", "snap_s", "dead_s"), "clip_id")
    rows = rows.join(t["external_ids"].filter("provider = 'bdb'").select("game_id", "external_id"), "game_id")
    rows = rows.withColumn("play_number", trailing_number(F.col("source_row_id"))).drop("play_id", "ordinal").distinct()
    return rows.orderBy("game_id", "clip_id", "action_order")


def single_play_of_clips(sources: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips that map to exactly one play of the answer key, others with a reason).

    known: game_id and play_number of the plays that have a signature; a missing number is a play of its own.
    """
    rows = joins.with_existence(sources, known, ["game_id", "play_number"], "known")
    number = F.coalesce(F.col("play_number").cast("string"), F.lit(""))
    per = rows.groupBy("clip_id").agg(F.countDistinct(number).alias("n"), F.max("play_number").alias("play_number"), F.max("known").alias("known"))
    reason = F.when(F.col("n") != 1, "clip is a source for multiple plays").when(~F.col("known"), "no play signature in the answer key")
    return per.filter(reason.isNull()).select("clip_id", "play_number"), per.filter(reason.isNotNull()).select("clip_id", reason.alias("reason"))


def sampling_frame(t: Tables, game_id: str) -> DataFrame:
    """The eligible plays of a game that have an alignment which was not rejected; an unknown quarter counts as 0."""
    a = t["play_alignments"].filter("status <> 'rejected'").select("play_id", "game_id", "ordinal")
    rows = t["plays"].filter((F.col("game_id") == game_id) & F.col("eligible")).join(a, ["game_id", "ordinal"])
    return rows.withColumn("quarter", F.coalesce("quarter", F.lit(0)))


def audit_sample(t: Tables, game_id: str, n: int = 40) -> DataFrame:
    """n plays over quarters and kinds, from the middle of each, in order; raises if there are fewer."""
    rows = sampling_frame(t, game_id)
    there = rows.count()
    if there < n:
        raise ValueError(f"only {there} aligned eligible plays, {n} wanted")
    return sample.stratified_middle_out(rows, ["quarter", "play_type"], "ordinal", n).orderBy("ordinal")


def audits_of_sample(t: Tables, game_id: str, chosen: DataFrame) -> DataFrame:
    """The audits when a sample takes the place of all audits of its game."""
    own = t["play_alignments"].filter(F.col("game_id") == game_id).select("play_id")
    fresh = chosen.select("play_id").withColumn("selected", F.lit(True))
    return t["audits"].join(own, "play_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def audit_summary(t: Tables, game_id: str) -> DataFrame:
    """How many plays were selected and reviewed, and the shares found right among the reviewed ones."""
    rows = t["audits"].filter("selected").join(t["play_alignments"].filter(F.col("game_id") == game_id).select("play_id"), "play_id")
    found = lambda c: rate(F.when(F.col("mapping_correct").isNotNull(), F.col(c))).alias(c)
    return rows.agg(F.count("*").alias("selected"), F.count("mapping_correct").alias("audited"), *map(found, ("mapping_correct", "sources_correct", "timing_correct")))


def alignment_work_list(t: Tables, game_id: str) -> DataFrame:
    """The alignment operations of a game in order, with what is known of their plays; operations without a play stay."""
    p = t["plays"].select("game_id", "ordinal", "description", "play_type")
    return t["alignment_operations"].filter(F.col("game_id") == game_id).join(p, ["game_id", "ordinal"], "left").orderBy("sequence_no")


def filmed_units(t: Tables, game_id: str) -> DataFrame:
    """Pairs of actions of a game in the order of the film: pair_id, action_id, duration and confidence of the primary action."""
    w = t["action_windows"].select(F.col("action_id").alias("primary_action_id"), "clip_id", "action_order", "snap_s", "dead_s", "confidence")
    rows = t["action_pairs"].filter(F.col("game_id") == game_id).select("pair_id", "primary_action_id").join(w, "primary_action_id").join(t["clips"].select("clip_id", "start_s"), "clip_id")
    place = F.row_number().over(Window.partitionBy(F.lit(game_id)).orderBy("start_s", "action_order"))
    return rows.select("pair_id", F.col("primary_action_id").alias("action_id"), place.alias("unit_no"), (F.col("dead_s") - F.col("snap_s")).alias("duration"), "confidence").orderBy("unit_no")


def misplaced_timings(timings: DataFrame, clips: DataFrame, columns: Sequence[str], strict: Sequence[str] = ()) -> DataFrame:
    """Timings that are not in ascending order within their clip. Those named in strict must lie after the one before them.

    timings has clip_id and the columns, clips has clip_id, start_s and end_s; a timing without a clip or
    with a missing value is misplaced.
    """
    bounds = clips.select("clip_id", F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))
    steps = ["_from", *columns, "_to"]
    ordered = [F.col(a) < F.col(b) if b in strict else F.col(a) <= F.col(b) for a, b in zip(steps, steps[1:])]
    good = ordered[0]
    for test in ordered[1:]:
        good = good & test
    return timings.join(bounds, "clip_id", "left").filter(~F.coalesce(good, F.lit(False))).drop("_from", "_to")


def verified_windows(windows: DataFrame, timings: DataFrame, clips: DataFrame) -> DataFrame:
    """Action windows with new timings in place, which makes them verified; raises if one is misplaced."""
    columns = ["formation_start_s", "snap_s", "dead_s", "playback_end_s"]
    new = timings.select("action_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    placed = windows.join(new, "action_id", "left")
    for c in columns:
        placed = placed.withColumn(c, F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)))
    placed = placed.withColumn("status", F.when(F.col("_new"), "verified").otherwise(F.col("status")))
    if not misplaced_timings(placed.filter("_new"), clips, columns).isEmpty():
        raise ValueError("timings must be in order and inside their clip")
    return placed.select(windows.columns)


def saved_keyframes(keyframes: DataFrame, clips: DataFrame, new: DataFrame) -> DataFrame:
    """The keyframes when new ones (with matrix and errors) take the place of their clips' old ones, under the clip's next revision.

    Raises if there is none, or one lies outside of its clip.
    """
    if new.isEmpty():
        raise ValueError("a calibration needs a keyframe")
    if not misplaced_timings(new, clips, ["timestamp_s"]).isEmpty():
        raise ValueError("a keyframe lies outside of its clip")
    last = keyframes.groupBy("clip_id").agg(F.max("revision").alias("_last"))
    fresh = new.join(last, "clip_id", "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + 1).withColumn("status", F.lit("verified")).drop("_last")
    return replaced_groups(keyframes, conformed(fresh, "calibration_keyframes"), ["clip_id"])


def pilot_games(catalogue: DataFrame, plays_csv: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The one game of each wanted pair, with its number of plays; raises unless each has exactly one."""
    found = wanted.join(catalogue, list(keys), "left")
    wrong = found.groupBy(*keys).agg(F.count("game_id").alias("n")).filter("n <> 1")
    if not wrong.isEmpty():
        raise ValueError("a wanted game has none or several matches")
    return found.join(plays_csv.groupBy("game_id").agg(F.count("*").alias("plays")), "game_id", "left").fillna(0, ["plays"])


def align_actions(plays_: DataFrame, units: DataFrame, category: Column, skip: float = 1.1, gate: float = 1.75, sure: float = 0.65) -> DataFrame:
    """Filmed plays and units of film of each game in one order: match, missing and extra operations.

    plays_: game_id, ordinal and what `category` needs; units: game_id, unit_no, category, duration, confidence.
    Of two known categories only equal ones can match under the gate, so only such pairs are made: sides meet by
    category, and those without one meet all. The path is found from the listed pairs, which is exact.
    """
    w = lambda c: Window.partitionBy("game_id").orderBy(c)
    left = plays_.withColumn("i", F.row_number().over(w("ordinal")) - 1).withColumn("_category", category)
    right = units.withColumn("j", F.row_number().over(w("unit_no")) - 1).withColumnsRenamed({"category": "unit_category"})
    meets = lambda c, other: F.when(F.col(c) == "unknown", F.array(F.lit(other))).otherwise(F.array(F.concat(F.lit("="), c), F.lit("any")))
    asked = left.select("game_id", "i", "_category", F.explode(meets("_category", "all")).alias("_meet"))
    # A unit answers for its own category or as one without, and to plays without.
    answers = F.array(F.when(F.col("unit_category") == "unknown", F.lit("any")).otherwise(F.concat(F.lit("="), "unit_category")), F.lit("all"))
    there = right.select("game_id", "j", "unit_category", "duration", "confidence", F.explode(answers).alias("_meet"))
    pairs = asked.join(there, ["game_id", "_meet"])
    costs = pairs.withColumn("cost", event_cost(F.col("_category"), F.col("unit_category"), F.col("duration"), F.col("confidence"))).filter(F.col("cost") <= gate)
    return aligned(left, right, costs, ["game_id"], skip, skip, gate, sure)


# Kinds of plays that are filmed even where they are not eligible.
FILMED_PLAY_KINDS = ("pass", "run", "punt", "kickoff", "field_goal", "extra_point", "qb_kneel", "qb_spike", "no_play")


def plays_to_align(plays_: DataFrame, every_filmed: bool = False) -> DataFrame:
    """Eligible plays and, if asked for, those of other filmed kinds."""
    return plays_.filter(F.col("eligible") | F.col("play_type").isin(*FILMED_PLAY_KINDS)) if every_filmed else plays_.filter("eligible")


def align_clips(plays_: DataFrame, groups: DataFrame, cost: Column, skip_play: float = 5.0, skip_group: float = 4.0) -> DataFrame:
    """Plays and groups of clips of each game in one order; groups without a play are left out of the result.

    cost is over both sides' columns, such as match.group_cost() of an array of sources.
    """
    w = lambda c: Window.partitionBy("game_id").orderBy(c)
    left, right = plays_.withColumn("i", F.row_number().over(w("ordinal")) - 1), groups.withColumn("j", F.row_number().over(w("group_no")) - 1)
    costs = left.join(right.drop("group_no"), "game_id").withColumn("cost", cost)
    return aligned(left, right, costs, ["game_id"], skip_play, skip_group).filter("operation <> 'extra'")


def pilot_report(t: Tables) -> DataFrame:
    """Counts of clips with tracks and actions, of actions by state, and of alignment operations, by game."""
    kind = lambda k, c: t["artifacts"].filter(F.col("kind") == k).select("clip_id").distinct().withColumn(c, F.lit(1))
    clips = t["clips"].join(kind("clip_detections", "detected"), "clip_id", "left").join(kind("clip_tracks", "tracked"), "clip_id", "left")
    per = clips.groupBy("game_id").agg(F.count("*").alias("clips"), F.count("detected").alias("detected_clips"), F.count("tracked").alias("tracked_clips"))
    actions = t["action_windows"].join(t["clips"].select("clip_id", "game_id"), "clip_id").groupBy("game_id").agg(F.count("*").alias("actions"), count_where(F.col("status") == "verified").alias("verified_actions"))
    ops = t["alignment_operations"].groupBy("game_id", "operation").count().groupBy("game_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("operation", "count")))).alias("operations"))
    return t["games"].select("game_id").join(per, "game_id", "left").join(actions, "game_id", "left").join(ops, "game_id", "left").fillna(0)


@dataclass(frozen=True)
class QualityThresholds:
    """What each metric must reach, or must not exceed."""

    at_least: tuple[tuple[str, float, str], ...] = (
        ("segmentation_confidence", 0.90, "snap/end segmentation confidence below threshold"),
        ("alignment_confidence", 0.98, "alignment confidence below threshold"),
        ("track_coverage", 0.95, "track coverage below threshold"),
        ("angle_agreement", 0.90, "agreement of angles below threshold"),
        ("identity_confidence", 0.97, "identity confidence below threshold"),
    )
    at_most: tuple[tuple[str, float, str], ...] = (
        ("median_field_error", 1.0, "median field calibration error exceeded threshold"),
        ("p95_field_error", 2.0, "p95 field calibration error exceeded threshold"),
    )
    members: int = 11
    identities: str = "expected exactly 11 unique jersey identities per team at snap"


def quality_gate(metrics: DataFrame, identities: DataFrame, key: str, thresholds: QualityThresholds = QualityThresholds()) -> DataFrame:
    """accepted or rejected with reasons, for each row of metrics; a missing metric counts as the worst.

    identities: key, team, jersey; there must be exactly two teams of so many distinct jerseys.
    """
    sizes = identities.groupBy(key, "team").agg(F.countDistinct("jersey").alias("n")).groupBy(key).agg(F.sort_array(F.collect_list("n")).alias("_sizes"))
    rows = metrics.join(sizes, key, "left")
    full = F.array(*[F.lit(thresholds.members).cast("long")] * 2)
    reasons = [F.when(~F.coalesce(F.col("_sizes") == full, F.lit(False)), thresholds.identities)]
    reasons += [F.when(F.coalesce(F.col(c), F.lit(0.0)) < v, r) for c, v, r in thresholds.at_least]
    reasons += [F.when(F.coalesce(F.col(c), F.lit(float("inf"))) > v, r) for c, v, r in thresholds.at_most]
    out = rows.withColumn("reasons", present(*reasons)).drop("_sizes")
    return out.withColumn("status", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected"))


def clip_gate(clips: DataFrame) -> DataFrame:
    """Reasons why a reconstructed clip needs review: valid_share, on_field_share, tracks and actions."""
    tests = [(F.col("valid_share") >= 0.75, "calibration coverage"), (F.col("on_field_share") >= 0.75, "on-field share"), (F.col("tracks").between(18, 35), "track count"), (F.col("actions") >= 1, "no action")]
    out = clips.withColumn("reasons", present(*[F.when(~F.coalesce(ok, F.lit(False)), r) for ok, r in tests]))
    return out.withColumn("status", F.when(F.size("reasons") == 0, "complete").otherwise("review"))


class GateError(RuntimeError):
    """A gate refused; nothing was written."""


PINNED = ("sha256", "model_version", "config_hash", "calibration_revision")


def frozen_protocol(sources: DataFrame, windows: DataFrame, inputs: DataFrame, answers: DataFrame, version: int, evaluator: str, parameters: str) -> DataFrame:
    """A row for each source that is to be scored the same way from now on: its window, inputs, answer rows, parameters and split."""
    rows = sources.join(windows, "clip_id").join(inputs, "clip_id").join(answers, "clip_id")
    pinned = rows.withColumn("protocol_version", F.lit(version)).withColumn("evaluator_version", F.lit(evaluator)).withColumn("parameters", F.lit(parameters))
    return sample.hash_split(pinned, "clip_id")


def checked_protocol(frozen: DataFrame, current: DataFrame, version: int, evaluator: str, parameters: str, allow_drift: bool = False) -> DataFrame:
    """Drift notes of the frozen sources. Raises for another version or other parameters, for sources that are missing or whose answers changed, and for drift that is not allowed."""
    other = frozen.filter(~(F.col("protocol_version").eqNullSafe(F.lit(version)) & F.col("evaluator_version").eqNullSafe(F.lit(evaluator)) & F.col("parameters").eqNullSafe(F.lit(parameters))))
    if not other.isEmpty():
        raise GateError("the protocol was frozen for another evaluator")
    changed = joins.differing(frozen, current, ["clip_id"], ["answer_snap", "answer_rows", *PINNED]).filter("difference <> 'added'")
    hard = changed.filter(F.col("difference").isin("missing", "answer_snap", "answer_rows")).limit(20).collect()
    if hard:
        raise GateError("; ".join(f"{r.clip_id}: {r.difference}" for r in hard))
    drift = changed.filter(F.col("difference").isin(*PINNED))
    if not allow_drift and not drift.isEmpty():
        raise GateError("; ".join(f"{r.clip_id}: {r.difference} drifted" for r in drift.limit(20).collect()))
    return drift


def unfinished(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to be done: items without a finished output."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def unknown_requests(requested: DataFrame, known: DataFrame, key: str) -> None:
    """Raises if anything is asked for that there is not."""
    bad = requested.select(key).exceptAll(known.select(key).distinct()).limit(20).collect()
    if bad:
        raise GateError(f"unknown: {', '.join(str(r[0]) for r in bad)}")


def shown_tracks(tracks: DataFrame, stride: int = 1) -> DataFrame:
    """What a reader of clips' tracks gets: the roster where there is one, else reliable tracks, else all; at every stride-th time of a clip."""
    if not 1 <= stride <= 20:
        raise ValueError("the stride is 1 to 20")
    return sample.every_nth_time(sample.preferred(tracks, ["roster_candidate", "track_reliable"], ["clip_id"]), ["clip_id"], "video_timestamp", stride)


def calibration_context(t: Tables) -> DataFrame:
    """For each clip what its calibration starts from: film, yard line, possession and kind of its play, its best snap and its latest tracks.

    A clip of several plays has a row for each. Verified windows come before others, then the surest.
    """
    best = F.max_by("snap_s", F.struct((F.col("status") == "verified").alias("v"), "confidence", -F.col("action_order")))
    snaps = t["action_windows"].groupBy("clip_id").agg(best.alias("snap_s"))
    tracks = latest_artifacts(t, "clip_tracks").select("clip_id", F.col("path").alias("tracks_path"))
    rows = t["clips"].drop("snap_s", "play_end_s", "confidence").join(t["games"].select("game_id", "video_path"), "game_id")
    rows = rows.join(t["play_sources"].select("clip_id", "play_id"), "clip_id", "left")
    rows = rows.join(t["play_alignments"].select("play_id", F.col("game_id").alias("_game"), F.col("ordinal").alias("_ordinal")), "play_id", "left")
    plays = t["plays"].select(F.col("game_id").alias("_game"), F.col("ordinal").alias("_ordinal"), "yard_line", "possession", "play_type")
    rows = rows.join(plays, ["_game", "_ordinal"], "left").join(snaps, "clip_id", "left").join(tracks, "clip_id", "left")
    return rows.select("clip_id", "game_id", "start_s", "end_s", "angle", "video_path", "yard_line", "possession", "play_type", "snap_s", "tracks_path")


def with_team_names(df: DataFrame, team: str, games: DataFrame) -> DataFrame:
    """df, which has game_id, with `home` and `away` replaced by the names of its game's sides; other values stay."""
    named = df.join(games.select("game_id", F.col("home").alias("_home"), F.col("away").alias("_away")), "game_id", "left")
    side = F.when(F.col(team) == "home", F.col("_home")).when(F.col(team) == "away", F.col("_away"))
    return named.withColumn(team, F.coalesce(side, F.col(team))).select(*df.columns)

