"""Where artifacts come from: rows read and written, hashes of settings, and revisions carried from one artifact to the next."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..kernels.tracker import TrackerOptions
from ..sinks import tables as sinks
from .catalog import latest

DETECTIONS, PROJECTION, TRACKS = "clip_detections", "clip_projection", "clip_tracks"


def config_hash(config: dict) -> str:
    """Sixteen digits that are the same for the same settings, in whatever order they are written."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def tracking_config(options: TrackerOptions, **more) -> dict:
    return {"tracker": options.as_dict(), **more}


def imported(source: DataFrame, shaped: Callable[[DataFrame], DataFrame], path: str, by: Sequence[str] = ()) -> Row:
    """Writes shaped(source) in place of the table, or of the partitions it has; rows_read and rows_written are counted on the way, in one pass."""
    read, wrote = Observation(), Observation()
    made = shaped(source.observe(read, F.count(F.lit(1)).alias("n"))).observe(wrote, F.count(F.lit(1)).alias("n"))
    sinks.overwrite(made, path, by)
    return Row(path=path, rows_read=read.get["n"], rows_written=wrote.get["n"])


def appended(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with the new entries after its greatest artifact_id, in the order of clip_id and kind."""
    return sinks.appended_to_ledger(ledger, new.withColumn("entry", F.struct("clip_id", "kind")))


def latest_of(ledger: DataFrame, kind: str) -> DataFrame:
    return latest(ledger.filter(F.col("kind") == kind), ["clip_id"], F.col("artifact_id").desc())


def projection_entries(projection: DataFrame, keyframes: DataFrame, path: str) -> DataFrame:
    """An entry for each clip of a projection: how much of it is valid, and the revision of the calibration that made it."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    rows = projection.groupBy("clip_id").agg(F.count("*").alias("rows"), share("calibration_valid").alias("valid_fraction"), share("on_field").alias("on_field_fraction"))
    revision = keyframes.groupBy("clip_id").agg(F.max("revision").cast("int").alias("input_revision"))
    summary = F.to_json(F.struct("rows", "valid_fraction", "on_field_fraction"))
    return rows.withColumn("metadata_json", summary).join(revision, "clip_id", "left").select("clip_id", F.lit(PROJECTION).alias("kind"), F.lit(path).alias("path"), "metadata_json", "input_revision")


def track_entries(tracks: DataFrame, ledger: DataFrame, config: dict, path: str) -> DataFrame:
    """An entry for each clip of tracks: counts, the hash of the settings, and the revision of the latest projection, carried on."""
    one = lambda c: F.countDistinct(F.when(F.col(c), F.col("track_id")))
    rows = tracks.groupBy("clip_id").agg(
        F.count("*").alias("rows"), F.countDistinct("track_id").alias("tracks"), one("track_reliable").alias("reliable_tracks"), one("roster_candidate").alias("roster_tracks"),
        F.avg((F.col("team") != "unknown").cast("double")).alias("team_labeled_fraction"), F.first("snap_s", ignorenulls=True).alias("snap_s"),
    )
    digest = config_hash(config)
    summary = F.to_json(F.struct(*(c for c in rows.columns if c != "clip_id"), F.lit(digest).alias("config_hash")))
    before = latest_of(ledger, PROJECTION).select("clip_id", "input_revision")
    made = rows.withColumn("metadata_json", summary).join(before, "clip_id", "left")
    return made.select("clip_id", F.lit(TRACKS).alias("kind"), F.lit(path).alias("path"), "metadata_json", F.lit(digest).alias("config_hash"), "input_revision")


def outdated(ledger: DataFrame, keyframes: DataFrame, config: dict) -> DataFrame:
    """clip_id and reason for each latest artifact that something before it has left behind.

    A projection is outdated by a new revision of its clip's calibration, tracks by a projection of another revision and by
    other settings. Clips without tracks have none to be outdated.
    """
    now = keyframes.groupBy("clip_id").agg(F.max("revision").cast("int").alias("now"))
    projection = latest_of(ledger, PROJECTION).select("clip_id", F.col("input_revision").alias("projected"))
    tracks = latest_of(ledger, TRACKS).select("clip_id", F.col("input_revision").alias("tracked"), "config_hash")
    both = projection.join(now, "clip_id", "left").join(tracks, "clip_id", "full")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reasons = [
        F.when(F.col("projected").isNotNull() & differ("projected", "now"), F.lit("projection: other calibration")),
        F.when(F.col("config_hash").isNotNull() & differ("tracked", "projected"), F.lit("tracks: other projection")),
        F.when(F.col("config_hash") != config_hash(config), F.lit("tracks: other settings")),
    ]
    return both.select("clip_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


# What makes a reconstruction one to be looked at, and the names of the reasons.
LEAST_FRACTION, PLAUSIBLE_TRACKS = 0.75, (18, 35)


def reconstruction_quality(projection: DataFrame, tracks: DataFrame, actions: DataFrame) -> DataFrame:
    """clip_id, quality_status (usable or review) and quality_reasons of each clip of the projection."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    rows = projection.groupBy("clip_id").agg(share("calibration_valid").alias("valid"), share("on_field").alias("inside"))
    reliable = tracks.filter("track_reliable").groupBy("clip_id").agg(F.countDistinct("track_id").alias("reliable"))
    live = actions.select("clip_id").distinct().withColumn("live", F.lit(True))
    both = rows.join(reliable, "clip_id", "left").join(live, "clip_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("valid") < LEAST_FRACTION, "calibration_coverage_below_75_percent"), F.when(F.col("inside") < LEAST_FRACTION, "on_field_detections_below_75_percent"),
        F.when(~F.coalesce("reliable", F.lit(0)).between(*PLAUSIBLE_TRACKS), "implausible_reliable_track_count"), F.when(F.col("live").isNull(), "no_live_action_detected"),
    ))
    return both.select("clip_id", F.when(F.size(reasons) > 0, "review").otherwise("usable").alias("quality_status"), reasons.alias("quality_reasons"))
