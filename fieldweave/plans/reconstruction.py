"""From projected detections to tracks: a scouting run finds when the play is live, the real run is anchored on its snap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels.tracker import TrackerOptions
from ..operators import aggregate, match, tracking
from ..sinks.lineage import settled
from . import actions, batch

CLIP = ["clip_id"]


def estimated_windows(scout: DataFrame, clips: DataFrame, options: actions.ActivityOptions = actions.ActivityOptions()) -> DataFrame:
    """clip_id, snap_s and dead_s of the action of each clip that lasts longest for sure; clips without motion are left out.

    Only motion is looked at, so the first run of a clip gives what every later one gives.
    """
    found = actions.discovered(scout, clips, options)
    weight = (F.col("dead_s") - F.col("snap_s")) * F.col("confidence")
    first = Window.partitionBy("clip_id").orderBy(weight.desc(), "action_order")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("clip_id", "snap_s", "dead_s")


#: Values of an embedding in an appearance.
EMBEDDING = 64


def looked_at(df: DataFrame) -> list[str]:
    """The columns of colours and of an embedding that df has."""
    return [c for c in (*tracking.COLOURS, *(f"emb_{i:02d}" for i in range(EMBEDDING))) if c in df.columns]


def with_looks(df: DataFrame) -> DataFrame:
    """df with the appearance of each row: its colours, and its embedding where df has one."""
    embedded = any(c.startswith("emb_") for c in looked_at(df))
    return tracking.with_appearance(df, EMBEDDING if embedded else 0)


def scouted(valid: DataFrame, clips: DataFrame, options: TrackerOptions = TrackerOptions()) -> DataFrame:
    """Places and speeds of tracks without an anchor, with what makes them reliable."""
    seen = [c for c in valid.columns if c in ("detection_id", "video_timestamp", "field_x", "field_y", "confidence", "angle", *tracking.BOX)]
    clustered = tracking.colour_clusters(valid.select("clip_id", *seen, *looked_at(valid)), "clip_id")
    rows = tracking.tracked(with_looks(clustered).select("clip_id", *seen, "team", "appearance"), "clip_id", options, angle="angle")
    rows = settled(rows.select("clip_id", "track_id", "video_timestamp", "field_x", "field_y", "speed"))
    cover = aggregate.track_coverage(rows, CLIP, "track_id", "video_timestamp")
    return rows.join(cover.select("clip_id", "track_id", F.col("reliable").alias("track_reliable")), ["clip_id", "track_id"])


def scaled(appearance: str = "appearance"):
    """An appearance with each dimension divided by its scale; those of an embedding have the scale 1."""
    scale = F.array(*map(F.lit, tracking.APPEARANCE_SCALE))
    return F.transform(appearance, lambda v, i: v / F.coalesce(F.get(scale, i), F.lit(1.0)))


def reconstructed(projection: DataFrame, clips: DataFrame, options: TrackerOptions = TrackerOptions(), activity: actions.ActivityOptions = actions.ActivityOptions()) -> DataFrame:
    """Tracks of each clip with teams, roles, reliability and roster, and the snap that was estimated.

    projection: detections with field_x, field_y, on_field and calibration_valid, colours, an embedding if
    there is one, and boxes; clips: clip_id, angle, start_s and end_s. Boxes from the end zone change too fast
    to tell tracks apart. Clips without a valid detection have no tracks.
    """
    valid = projection.filter(F.col("on_field") & F.col("calibration_valid")).drop("angle", "team", "appearance")
    valid = valid.join(clips.select("clip_id", "angle"), "clip_id", "left")
    snaps = settled(estimated_windows(settled(scouted(valid, clips, options)), clips, activity).select("clip_id", "snap_s"))
    anchored = tracking.colour_clusters(valid, "clip_id", snaps.withColumnRenamed("snap_s", "anchor_s"))
    rows = tracking.tracked(with_looks(anchored), "clip_id", options, angle="angle").withColumn("appearance", scaled())
    boxes = {"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")} if set(tracking.BOX) <= set(rows.columns) else {c: F.lit(None).cast("double") for c in ("width", "height")}
    rows = match.chained(match.relinked(rows.withColumns(boxes), CLIP), CLIP)
    rows = tracking.resolved_teams(rows, "clip_id", snaps)
    rows = tracking.with_roster(rows, "clip_id", snaps).drop("width", "height", "angle").join(snaps, "clip_id", "left")
    # An appearance is as long without an embedding as with one; its zeros are added where nothing is computed from them any more.
    width = len(tracking.COLOURS) + EMBEDDING
    return rows.withColumn("appearance", F.concat("appearance", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), width - F.size("appearance")))))


def reconstruct_game(projection: DataFrame, clips: DataFrame, path: str, options: TrackerOptions = TrackerOptions(), activity: actions.ActivityOptions = actions.ActivityOptions(), *, waves: int = 8, resume: bool = True) -> DataFrame:
    """clip_id, status (cached, created or failed) and error of each clip that has detections; its tracks go below path.

    A clip that can't be reconstructed doesn't stop the others, and what is there isn't made again (plans.batch).
    """
    def work(some: DataFrame) -> DataFrame:
        return reconstructed(projection.join(some, "clip_id", "left_semi"), clips.join(some, "clip_id", "left_semi"), options, activity)

    keys = clips.select("clip_id").join(projection.select("clip_id").distinct(), "clip_id", "left_semi").distinct()
    return batch.run_batch(keys, work, path, waves=waves, resume=resume)


def reconstructed_rows(spark: SparkSession, path: str, clips: DataFrame) -> DataFrame | None:
    """The tracks of all clips that reconstruct_game has made below path."""
    return batch.finished(spark, path, clips.select("clip_id").distinct())
