"""Schemas of the catalog's tables and of the artifacts, and checks of columns.

Ids are text even where they look like numbers; media times are seconds as doubles, not timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = {
    "games": "game_id string not null, season int, week int, home string, away string, video_path string, page_url string, created_at timestamp",
    "plays": "game_id string not null, ordinal int not null, quarter int, clock string, possession string, down int, distance int, yard_line string, description string not null, play_type string not null, eligible boolean, source_row_id string",
    "clips": "clip_id string not null, game_id string, angle string, start_s double, end_s double, snap_s double, play_end_s double, confidence double",
    "play_alignments": "play_id string not null, game_id string, ordinal int, sideline_clip_id string, endzone_clip_id string, score double, status string, diagnostics_json string",
    "play_sources": "play_id string not null, source_order int not null, clip_id string, angle string",
    "truth_tracking": "game_id string, play_id string, frame_id int, player_id string, team string, jersey_number int, x double, y double, speed double, acceleration double, direction double, orientation double, event string, play_direction string",
    "quality_reports": "play_id string not null, status string, reasons_json string, metrics_json string, created_at timestamp",
    "artifacts": "artifact_id long not null, play_id string, kind string, path string, model_version string, metadata_json string, clip_id string, action_id string, config_hash string, input_revision int, created_at timestamp",
    "action_windows": "action_id string not null, clip_id string, action_order int, formation_start_s double, snap_s double, dead_s double, playback_end_s double, confidence double, status string",
    "calibration_keyframes": "clip_id string not null, timestamp_s double not null, landmarks_json string, matrix array<array<double>>, inlier_ratio double, median_error double, p95_error double, revision int, status string",
    "action_pairs": "pair_id string not null, game_id string, primary_action_id string, alternate_action_id string, score double, status string",
    "action_alignments": "game_id string not null, ordinal int not null, pair_id string, action_id string, score double, status string, operation string",
    "alignment_operations": "game_id string, sequence_no int, operation string, ordinal int, pair_id string, score double, status string",
    "external_ids": "game_id string not null, provider string not null, external_id string",
    "audits": "play_id string not null, selected boolean, mapping_correct boolean, sources_correct boolean, timing_correct boolean, notes string",
}
KEYS = {
    "games": ["game_id"], "plays": ["game_id", "ordinal"], "clips": ["clip_id"], "play_alignments": ["play_id"], "play_sources": ["play_id", "source_order"],
    "truth_tracking": ["game_id", "play_id", "frame_id", "player_id"], "quality_reports": ["play_id"], "artifacts": ["artifact_id"], "action_windows": ["action_id"],
    "calibration_keyframes": ["clip_id", "timestamp_s"], "action_pairs": ["pair_id"], "action_alignments": ["game_id", "ordinal"], "alignment_operations": ["game_id", "sequence_no"],
    "external_ids": ["game_id", "provider"], "audits": ["play_id"],
}
#: child table: (its column, parent table, the parent's column, what becomes of children without a parent)
PARENTS = {
    "play_sources": [("play_id", "play_alignments", "play_id", "drop"), ("clip_id", "clips", "clip_id", "drop")],
    "action_windows": [("clip_id", "clips", "clip_id", "drop")],
    "calibration_keyframes": [("clip_id", "clips", "clip_id", "drop")],
    "action_pairs": [("primary_action_id", "action_windows", "action_id", "drop"), ("alternate_action_id", "action_windows", "action_id", "null")],
    "action_alignments": [("pair_id", "action_pairs", "pair_id", "null"), ("action_id", "action_windows", "action_id", "null")],
    "audits": [("play_id", "play_alignments", "play_id", "drop")],
}
ARTIFACTS = {
    "detections": "game_id string, clip_id string, frame_id int, video_timestamp double, detection_id long, x1 double, y1 double, x2 double, y2 double, contact_x double, contact_y double, confidence double, model_version string, lab_l double, lab_a double, lab_b double, hsv_h double, hsv_s double, hsv_v double, embedding array<float>",
    "labels": "game_id string, play_id string, frame_id int, t double, player_id string, team string, jersey_number int, x_normalized double, y_normalized double, speed double, acceleration double, direction double, orientation double, event string",
    "manifest": "game_id string, play_id string, clip_id string, angle string, video_path string, labels_path string, snap_s double, snap_frame int",
    "signature": "play_id string, duration double, category string, speed_profile array<double>, formation array<double>, events array<string>",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(CATALOG.get(name) or ARTIFACTS[name])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def conformed(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types of a table: those it lacks are null, NaN is null, others go."""
    out = []
    for field in schema(name):
        c = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        out.append((F.nanvl(c, F.lit(None).cast("double")) if isinstance(field.dataType, T.DoubleType) else c).alias(field.name))
    return df.select(*out)


def without_orphans(child: DataFrame, name: str, parents: dict[str, DataFrame]) -> DataFrame:
    """What a cascade leaves of a child table once its parents' rows are gone."""
    for column, table, key, fate in PARENTS.get(name, []):
        if table not in parents:
            continue
        there = parents[table].select(F.col(key).alias("_parent")).distinct()
        if fate == "drop":
            child = child.join(there, F.col(column) == F.col("_parent"), "left_semi")
        else:
            child = child.join(there, F.col(column) == F.col("_parent"), "left").withColumn(column, F.col("_parent")).drop("_parent")
    return child
