"""Windows of action in tracks and in motion scores, their signatures and pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import top_padded
from ..operators import aggregate
from ..operators import sequence as seq
from ..operators.match import paired_ahead, signature_cost
from ..operators.sample import reliable_or_all

Names = Sequence[str]


@dataclass(frozen=True)
class ActivityOptions:
    """Fixed values of live action in tracks: how fast counts as moving, how many must, and for how long."""

    moving: float = 1.15
    share: float = 0.28
    speed: float = 1.8
    tracks: int = 6
    smooth_s: float = 0.5
    bridge_s: float = 0.8
    least_s: float = 1.2
    lead_s: float = 2.5
    tail_s: float = 1.5
    edge_s: float = 0.35
    least_times: int = 4


def activity(rows: DataFrame, keys: Names, at: str, value: str, track: str, n: int, options: ActivityOptions) -> DataFrame:
    """The smoothed timeline of each key and its active times."""
    line = aggregate.timeline(rows, keys, at, value, track, options.moving)
    line = line.withColumn("smooth", seq.rolling_mean("activity", keys, at, n)).withColumn("pace", seq.rolling_median("middle", keys, at, n))
    active = (F.col("smooth") >= options.share) & (F.col("pace") >= options.speed) & (F.col("tracks") >= options.tracks)
    return line.withColumn("active", F.coalesce(active, F.lit(False)))


def discovered(tracks: DataFrame, clips: DataFrame, options: ActivityOptions = ActivityOptions()) -> DataFrame:
    """Action windows of each clip, from when most of its tracks move until they rest.

    tracks: clip_id, track_id, video_timestamp, field_x, field_y and perhaps speed and track_reliable;
    clips: clip_id, start_s, end_s. Clips of fewer than least_times times have no windows.
    """
    keys, at = ["clip_id"], "video_timestamp"
    rows = reliable_or_all(tracks, keys, "track_reliable") if "track_reliable" in tracks.columns else tracks
    moved = seq.with_speed(rows, ["clip_id", "track_id"], at, "field_x", "field_y", "_speed")
    if "speed" in tracks.columns:
        known = F.max(F.nanvl("speed", F.lit(None).cast("double")).isNotNull()).over(Window.partitionBy("clip_id"))
        moved = moved.withColumn("_speed", F.when(known, F.nanvl("speed", F.lit(None).cast("double"))).otherwise(F.col("_speed")))
    line = aggregate.timeline(moved, keys, at, "_speed", "track_id", options.moving)
    own = Window.partitionBy("clip_id")
    w = own.orderBy(at)
    line = line.withColumn("_dt", F.col(at) - F.lag(at).over(w)).withColumn("step", F.median("_dt").over(own)).withColumn("times", F.count("*").over(own)).filter(F.col("times") >= options.least_times)
    n = F.greatest(F.lit(1), F.rint(options.smooth_s / F.greatest("step", F.lit(0.01)))).cast("int")
    # The width of the frame differs between clips: rows of the widest frame there can be are cut to the clip's own.
    widest = round(options.smooth_s / 0.01)
    near = F.collect_list(F.struct("_i", "activity", "middle")).over(w.rowsBetween(-(widest // 2), (widest - 1) // 2))
    line = line.withColumn("n", n).withColumn("_i", F.row_number().over(w)).withColumn("_near", near)
    inside = F.filter("_near", lambda r: (r["_i"] >= F.col("_i") - F.floor(F.col("n") / 2)) & (r["_i"] <= F.col("_i") + F.floor((F.col("n") - 1) / 2)))
    line = line.withColumn("_in", inside).drop("_near")
    mean = F.aggregate("_in", F.lit(0.0), lambda s, r: s + r["activity"]) / F.size("_in")
    sorted_ = F.array_sort(F.filter(F.transform("_in", lambda r: r["middle"]), lambda v: v.isNotNull()))
    k = F.size(F.col("_sorted"))
    middle = F.when(k > 0, (F.get("_sorted", F.floor((k - 1) / 2).cast("int")) + F.get("_sorted", F.floor(k / 2).cast("int"))) / 2)
    line = line.withColumn("smooth", mean).withColumn("_sorted", sorted_).withColumn("pace", middle)
    active = (F.col("smooth") >= options.share) & (F.col("pace") >= options.speed) & (F.col("tracks") >= options.tracks)
    line = seq.bridged_by_time(line.withColumn("active", F.coalesce(active, F.lit(False))).drop("_in", "_sorted", "_dt", "_i"), keys, at, "active", options.bridge_s)
    lead = F.greatest(F.lit(1), F.rint(F.lit(options.lead_s) / F.greatest("step", F.lit(0.01)))).cast("int")
    tail = F.greatest(F.lit(1), F.rint(F.lit(options.tail_s) / F.greatest("step", F.lit(0.01)))).cast("int")
    times = line.groupBy("clip_id").agg(F.array_sort(F.collect_list(at)).alias("all_times"))
    line = line.withColumn("_i", F.row_number().over(w) - 1)
    runs = seq.runs(line, keys, at, "active", i0=F.min("_i"), i1=F.max("_i"), mean=F.avg("smooth"), lead=F.max(lead), tail=F.max(tail)).filter(F.col("last") - F.col("first") >= options.least_s)
    # One clip's distinct times are as many as its frames, some hundreds.
    found = runs.join(times, keys).join(clips.select("clip_id", "start_s", "end_s"), keys)
    begin = F.get("all_times", F.greatest(F.col("i0") - F.col("lead"), F.lit(0)))
    end = F.get("all_times", F.least(F.col("i1") + F.col("tail"), F.size("all_times") - 1))
    collides = (F.col("first") - F.col("start_s") < options.edge_s) | (F.col("end_s") - F.col("last") < options.edge_s)
    trust = F.least(F.lit(0.99), 0.45 + 0.45 * F.col("mean")) * F.when(collides, 0.6).otherwise(1.0)
    return found.select(
        "clip_id", F.row_number().over(Window.partitionBy("clip_id").orderBy("first")).alias("action_order"), F.greatest(begin, F.col("start_s")).alias("formation_start_s"), F.col("first").alias("snap_s"),
        F.col("last").alias("dead_s"), F.least(end, F.col("end_s")).alias("playback_end_s"), trust.alias("confidence"), F.when(collides, "review").otherwise("candidate").alias("status"),
    )


def motion_windows(samples: DataFrame, keys: Names, rate: float, *, at: str = "timestamp", score: str = "score", cut: str = "camera_cut", least: float = 2.0, most: float = 18.0, bridge_s: float = 3.0, lead: float = 0.6, tail: float = 0.8) -> DataFrame:
    """Windows of motion by hysteresis around robust thresholds of each key's scores; keys of fewer than 10 samples have none."""
    keys = list(keys)
    smooth = samples.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n >= 10").withColumn("smooth", seq.box_mean(score, keys, at))
    scale = aggregate.robust_scale(smooth.filter(~F.col(cut)), keys, "smooth", (0.35, 0.42, 0.67))
    high = F.greatest(F.col("p67"), F.col("p35") + 1.5 * F.col("mad"))
    low = F.greatest(F.col("p42"), F.col("p35") + 0.35 * F.col("mad"))
    marked = smooth.join(scale, keys).withColumn("_high", high).withColumn("_low", low)
    grown = seq.hysteresis(marked, keys, at, F.col("smooth") >= F.col("_high"), F.col("smooth") >= F.col("_low"), F.col(cut))
    bridged = seq.bridged_by_count(grown, keys, at, "active", max(1, round(bridge_s * rate)))
    first = samples.groupBy(*keys).agg(F.min(at).alias("_t0"))
    length = F.col("last") - F.col("first") + 1 / rate
    return seq.runs(bridged, keys, at, "active", peak=F.max("smooth")).filter(length.between(least, most)).join(first, keys).select(*keys, F.greatest(F.col("first") - lead, F.col("_t0")).alias("start"), (F.col("last") + tail).alias("end"), "peak")


def clips_of_sources(samples: DataFrame, cuts: DataFrame, durations: DataFrame, probes: DataFrame, rate: float, *, source: str = "source") -> DataFrame:
    """One clip for each span between cuts: its angle by vote, its window of most motion, and a confidence.

    samples: source, timestamp, score, camera_cut; cuts: source, at; durations: source, duration; probes:
    source, at, angle, confidence. Cuts nearer than 1.5 s to the last one kept go; spans shorter than 3 s go.
    A span without such a window has null times and confidence 0. Only sideline and endzone are voted for;
    the sideline wins a draw.
    """
    from ..operators.folds import min_separation

    at = F.col("timestamp")
    usable = samples.filter(~F.coalesce(F.col("camera_cut"), F.lit(False)))
    kept = min_separation(cuts.select(source, F.col("at").cast("double").alias("at")), [source], "at", 1.5)
    kept = kept.join(durations, source).filter((F.col("at") > 0) & (F.col("at") < F.col("duration"))).select(source, "at")
    ends = durations.select(source, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("at")).unionByName(kept)
    spans = seq.between_cuts(ends.distinct(), [source], "at", 3.0)
    limit = usable.groupBy(source).agg(F.percentile("score", 0.6).alias("_p60"))
    spans = spans.join(limit, source, "left").withColumn("limit", F.greatest(F.lit(20.0), F.coalesce("_p60", F.lit(20.0)))).drop("_p60")
    key = [source, "number"]

    inside = usable.join(spans, source).filter((at > F.col("start")) & (at < F.col("end")))
    inside = inside.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).filter("_n >= 10")
    inside = inside.withColumn("smooth", seq.box_mean("score", key, "timestamp")).withColumn("active", F.col("smooth") >= F.col("limit"))
    bridged = seq.bridged_by_count(inside, key, "timestamp", "active", max(1, round(2 * rate)))
    runs = seq.runs(bridged, key, "timestamp", "active", energy=F.sum("smooth"), peak=F.max("smooth")).filter(F.col("n") >= max(2, round(0.6 * rate)))
    best = runs.groupBy(*key).agg(F.max(F.struct("energy", "first", "last", "peak")).alias("b"))

    voted = probes.join(spans, source).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    votes = voted.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(F.col("angle") == a, F.col("confidence"))), F.lit(0.0)).alias(f"_{a}") for a in ("sideline", "endzone")])
    side, zone = (F.coalesce(c, F.lit(0.0)) for c in ("_sideline", "_endzone"))
    out = spans.join(best, key, "left").join(votes, key, "left")
    snap, dead = F.greatest("start", F.col("b.first") - 0.6), F.least("end", F.col("b.last") + 0.8)
    live = F.col("b").isNotNull() & (dead - snap >= 1.5)
    share = F.greatest(side, zone) / F.greatest(side + zone, F.lit(1e-9))
    motion = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("b.peak") / F.greatest(3 * F.col("limit"), F.lit(1.0))))
    return out.select(
        source, "number", "start", "end", F.when(zone > side, "endzone").otherwise("sideline").alias("angle"), F.when(live, snap).alias("snap_s"), F.when(live, dead).alias("play_end_s"),
        F.when(live, F.least(motion, F.greatest(F.lit(0.05), share))).otherwise(0.0).alias("confidence"),
    )


def motion_bounds(samples: DataFrame, keys: Names, rate: float, *, at: str = "timestamp", score: str = "score") -> DataFrame:
    """When motion sets in and when it rests, of each key's scores, and how far the onset stands out.

    The threshold lies above the median of the first quarter of the scores (10 at least). Keys of fewer than
    20 samples or without an onset are left out.
    """
    keys, own = list(keys), Window.partitionBy(*keys)
    rows = samples.withColumn("_n", F.count("*").over(own)).filter("_n >= 20").withColumn("_i", F.row_number().over(own.orderBy(at)))
    base = rows.filter(F.col("_i") <= F.greatest(F.lit(10), F.floor(F.col("_n") / 4)))
    base = base.withColumn("_m", F.median(score).over(own)).withColumn("_away", F.abs(F.col(score) - F.col("_m")))
    spread = F.median("_away")
    scale = base.groupBy(*keys).agg((F.max("_m") + F.greatest(F.lit(1.0), 4 * F.when(spread == 0, 0.1).otherwise(spread))).alias("threshold"))
    marked = rows.join(scale, keys)
    active = F.col(score) > F.col("threshold")
    found = seq.sustained(marked, keys, at, active, 3, ~active, F.lit(max(20, round(rate * 3))), quiet_rows=max(8, round(rate * 1.5)), margin=1)
    first = marked.select(*keys, F.col(at).alias("start"), score, "threshold")
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(score) - F.col("threshold")) / F.greatest("threshold", F.lit(1.0))))
    return found.join(first, [*keys, "start"]).select(*keys, "start", "end", trust.alias("confidence"))


def action_signatures(tracks: DataFrame, windows: DataFrame) -> DataFrame:
    """Duration, top two team sizes, displacement, speed profile and formation of each action.

    tracks: clip_id, track_id, team, video_timestamp, field_x, field_y, speed; windows: action_id, clip_id,
    angle, action_order, snap_s, dead_s. The formation is that of each track's median place in the first half
    second. An action without rows has no profile and no formation.
    """
    key = ["action_id"]
    rows = windows.select("action_id", "clip_id", "snap_s", "dead_s").join(tracks, "clip_id").filter(F.col("video_timestamp").between(F.col("snap_s"), F.col("dead_s")))
    teams = rows.filter("team is not null").groupBy("action_id", "team").agg(F.countDistinct("track_id").cast("double").alias("n"))
    teams = teams.groupBy("action_id").agg(top_padded(F.collect_list("n"), 2, 0.0).alias("team_counts"))
    moved = aggregate.displacement(rows, key, "track_id", "video_timestamp", "field_x", "field_y")
    profile = aggregate.binned_profile(rows, key, "video_timestamp", "speed", low=F.col("snap_s"), high=F.col("dead_s"))
    early = rows.filter(F.col("video_timestamp") <= F.col("snap_s") + 0.5)
    places = early.groupBy("action_id", "track_id").agg(F.median("field_x").alias("x"), F.median("field_y").alias("y"))
    shape = aggregate.formation(places, key, "x", "y", 22, 2)
    duration = F.greatest(F.lit(0.01), F.col("dead_s") - F.col("snap_s"))
    base = windows.select("action_id", "clip_id", "angle", "action_order", "snap_s", duration.alias("duration"))
    out = base.join(teams, key, "left").join(moved, key, "left").join(profile, key, "left").join(shape, key, "left")
    none = F.array().cast("array<double>")
    return out.withColumns({"team_counts": F.coalesce("team_counts", F.array(F.lit(0.0), F.lit(0.0))), "displacement": F.coalesce("displacement", F.lit(0.0)), "profile": F.coalesce("profile", none), "formation": F.coalesce("formation", none)})


def paired_actions(signatures: DataFrame, game: str = "game_id", order: str = "position", **limits) -> DataFrame:
    """Actions of one game paired with one of the four after them in another clip, where the cost is low and clear."""
    return paired_ahead(signatures, [game], order, signature_cost(), F.col("clip_id") != F.col("other_clip_id"), **limits)


# The events of the answer key that begin a play, and those that tell its category.
SNAP_EVENTS = ("ball_snap", "autoevent_ballsnap")
PASS_EVENTS = ("pass_forward", "autoevent_passforward")
RUN_EVENTS = ("handoff", "run")


def play_signatures(truth: DataFrame, keys: Names = ("game_id", "play_id")) -> DataFrame:
    """Duration, category, speed profile, formation at the snap and events of each play of the answer key.

    Plays without a snap are left out. Rows without a player_id, such as the ball's, count for events and
    time alone.
    """
    keys = list(keys)
    event = F.lower("event")
    snap = F.min(F.when(event.isin(*SNAP_EVENTS), F.col("frame_id")))
    bounds = truth.groupBy(*keys).agg(snap.alias("snap_frame"), F.max("frame_id").alias("last_frame"), F.sort_array(F.collect_set(F.nullif(event, F.lit("")))).alias("events")).filter("snap_frame is not null")
    rows = truth.join(bounds.drop("events"), keys).filter((F.col("frame_id") >= F.col("snap_frame")) & F.col("player_id").isNotNull())
    profile = aggregate.binned_profile(rows, keys, "frame_id", "speed", out="speed_profile", low=F.col("snap_frame"), high=F.col("last_frame") + 1e-6)
    shape = aggregate.formation(rows.filter("frame_id = snap_frame"), keys, "x", "y", 10**6, 3)
    has = lambda names: F.arrays_overlap("events", F.array(*map(F.lit, names)))
    category = F.when(has(PASS_EVENTS), "pass").when(has(RUN_EVENTS), "run").otherwise("unknown")
    duration = F.greatest(F.lit(0.1), (F.col("last_frame") - F.col("snap_frame")) / 10)
    base = bounds.select(*keys, duration.alias("duration"), category.alias("category"), "events")
    out = base.join(profile, keys, "left").join(shape, keys, "left")
    return out.withColumns({"speed_profile": F.coalesce("speed_profile", F.array(*[F.lit(0.0)] * 8)), "formation": F.coalesce("formation", F.array().cast("array<double>"))})
