"""Batches that go on: failures are kept apart, finished keys are not done again, a stop in between loses nothing; ledgers and freezes."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldweave import schemas
from fieldweave.plans import batch, catalog, evaluation, ledger, reconstruction

NAMES = ["k"]


def work_of(spark, bad=(), stop=None, seen=None):
    @F.pandas_udf("double")
    def doubled(k: pd.Series) -> pd.Series:
        if k.isin(list(bad)).any():
            raise ValueError(f"no such clip as {next(x for x in k if x in bad)}")
        return k.str[1:].astype(float) * 2

    def work(keys):
        if seen is not None:
            seen.append(sorted(r.k for r in keys.collect()))
        if stop is not None and len(seen) > stop:
            raise KeyboardInterrupt
        return keys.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("v", doubled("k"))

    return work


def keys_of(spark, n):
    return spark.createDataFrame([(f"c{i}",) for i in range(n)], "k string")


def test_one_bad_key_does_not_stop_the_others(spark, tmp_path):
    path, keys = str(tmp_path / "out"), keys_of(spark, 20)
    got = {r.k: (r.status, r.error) for r in batch.run_batch(keys, work_of(spark, bad=["c7"]), path, waves=3).collect()}
    assert got.pop("c7") == ("failed", "ValueError: no such clip as c7") and set(got.values()) == {("created", None)} and len(got) == 19
    rows = batch.finished(spark, path, keys).collect()
    assert sorted((r.k, r.n, r.v) for r in rows) == sorted((f"c{i}", n, 2.0 * i) for i in range(20) if i != 7 for n in (1, 2))
    # A second run does only what is left, and now it works.
    seen = []
    again = {r.k: r.status for r in batch.run_batch(keys, work_of(spark, seen=seen), path, waves=3).collect()}
    assert seen == [["c7"]] and again.pop("c7") == "created" and set(again.values()) == {"cached"}
    assert batch.finished(spark, path, keys).count() == 40
    assert {r.status for r in batch.run_batch(keys, work_of(spark), path, waves=2, resume=False).collect()} == {"created"}
    assert batch.finished(spark, path, keys).count() == 40  # of the last word on each key


def test_a_stopped_batch_goes_on(spark, tmp_path):
    path, keys, seen = str(tmp_path / "out"), keys_of(spark, 30), []
    with pytest.raises(KeyboardInterrupt):
        batch.run_batch(keys, work_of(spark, seen=seen, stop=2), path, waves=5)
    done = {k for part in seen[:2] for k in part}
    (tmp_path / "out" / "rows" / "wave-0123").mkdir()  # what a crash between rows and status leaves
    assert {r.k for r in batch.statuses(spark, path, keys).collect()} == done
    left = []
    got = {r.k: r.status for r in batch.run_batch(keys, work_of(spark, seen=left), path, waves=5).collect()}
    assert {k for part in left for k in part} == {f"c{i}" for i in range(30)} - done
    assert {k for k, s in got.items() if s == "cached"} == done and set(got.values()) == {"cached", "created"}
    assert batch.finished(spark, path, keys).select("k").distinct().count() == 30
    assert batch.finished(spark, str(tmp_path / "none"), keys) is None


def test_a_game_is_reconstructed_but_for_a_bad_clip(spark, tmp_path):
    draw, rows = np.random.default_rng(8), []
    for clip in ("good", "bad", "fine"):
        for f in range(12):
            for i in range(4):
                rows.append((clip, f / 10, f * 4 + i, 10.0 + 20 * i + f / 10 + float(draw.normal(0, 0.01)), 20.0, True, True, 0.9, 60.0 + 30 * (i % 2), 10.0, 10.0, 20.0))
    d = spark.createDataFrame(rows, "clip_id string, video_timestamp double, detection_id long, field_x double, field_y double, on_field boolean, calibration_valid boolean, confidence double, lab_l double, lab_a double, lab_b double, hsv_s double")
    clips = spark.createDataFrame([(c, "sideline", 0.0, 2.0) for c in ("good", "bad", "fine", "empty")], "clip_id string, angle string, start_s double, end_s double")
    wrong = F.raise_error("ValueError: the clip is damaged").cast("double")
    d = d.withColumn("field_y", F.when(F.col("clip_id") == "bad", wrong).otherwise(F.col("field_y")))
    got = {r.clip_id: r for r in reconstruction.reconstruct_game(d, clips, str(tmp_path / "game"), waves=1).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "created", "fine": "created", "bad": "failed"} and "damaged" in got["bad"].error
    tracks = reconstruction.reconstructed_rows(spark, str(tmp_path / "game"), clips)
    assert {r.clip_id: r.n for r in tracks.groupBy("clip_id").agg(F.countDistinct("track_id").alias("n")).collect()} == {"good": 4, "fine": 4}


def test_errors_become_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", -1.0), (None, 2.0)], "k string, v double")

    def roots(rows):
        if (rows.v < 0).any():
            raise ValueError("negative")
        return rows.assign(root=rows.v**0.5)[["k", "root"]]

    got = sorted(map(tuple, batch.captured(df, NAMES, roots, "k string, root double").collect()), key=str)
    assert got == sorted([("a", 1.0, None), ("a", 3.0**0.5, None), (None, 2.0**0.5, None), ("b", None, "ValueError: negative")], key=str)


PROJECTION = "clip_id string, calibration_valid boolean, on_field boolean"
TRACKS = "clip_id string, track_id string, track_reliable boolean, roster_candidate boolean, team string, snap_s double"
KEYFRAMES = "clip_id string, revision int"


def test_a_ledger_carries_settings_and_revisions(spark):
    empty = schemas.conformed(spark.createDataFrame([], "artifact_id long, clip_id string, kind string"), "artifacts")
    keyframes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], KEYFRAMES)
    projection = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, False)], PROJECTION)
    tracks = spark.createDataFrame([("a", "t1", True, True, "team_0", 3.5), ("a", "t1", True, True, "team_0", 3.5), ("a", "t2", False, False, "unknown", 3.5)], TRACKS)
    config = ledger.tracking_config(ledger.TrackerOptions(), least=0.35)
    assert ledger.config_hash({"b": 1, "a": [1, 2]}) == ledger.config_hash({"a": [1, 2], "b": 1}) != ledger.config_hash({"a": [1, 2], "b": 2})
    book = ledger.appended(empty, ledger.projection_entries(projection, keyframes, "/p"))
    book = ledger.appended(book, ledger.track_entries(tracks, book, config, "/t"))
    rows = {(r.clip_id, r.kind): r for r in book.collect()}
    assert sorted(r.artifact_id for r in rows.values()) == [1, 2, 3]
    assert rows["a", "clip_projection"].input_revision == 2 and json.loads(rows["a", "clip_projection"].metadata_json) == {"rows": 2, "valid_fraction": 1.0, "on_field_fraction": 0.5}
    made = rows["a", "clip_tracks"]
    assert made.input_revision == 2 and made.config_hash == ledger.config_hash(config) and json.loads(made.metadata_json) == {
        "rows": 3, "tracks": 2, "reliable_tracks": 1, "roster_tracks": 1, "team_labeled_fraction": pytest.approx(2 / 3), "snap_s": 3.5, "config_hash": made.config_hash,
    }
    stale = lambda *a: sorted(map(tuple, ledger.outdated(*a).collect()))
    assert stale(book, keyframes, config) == []
    newer = keyframes.union(spark.createDataFrame([("a", 3)], KEYFRAMES))
    assert stale(book, newer, config) == [("a", "projection: other calibration")]
    again = ledger.appended(book, ledger.projection_entries(projection.filter("clip_id = 'a'"), newer, "/p2"))
    assert stale(again, newer, config) == [("a", "tracks: other projection")]
    assert stale(book, keyframes, {"other": 1}) == [("a", "tracks: other settings")]


def test_rows_read_and_written_are_counted(spark, tmp_path):
    got = ledger.imported(spark.range(10).toDF("x"), lambda df: df.filter("x % 2 = 0"), str(tmp_path / "t"))
    assert (got.rows_read, got.rows_written) == (10, 5) and spark.read.parquet(got.path).count() == 5


def test_quality_of_reconstructions(spark):
    projection = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True)], PROJECTION)
    tracks = spark.createDataFrame([(c, f"t{i}", True, True, "team_0", 1.0) for c, n in (("a", 20), ("b", 40)) for i in range(n)], TRACKS)
    got = {r.clip_id: (r.quality_status, r.quality_reasons) for r in ledger.reconstruction_quality(projection, tracks, spark.createDataFrame([("a",), ("b",)], "clip_id string")).collect()}
    assert got["a"] == ("usable", []) and got["b"] == ("review", ["on_field_detections_below_75_percent", "implausible_reliable_track_count"])
    assert got["c"] == ("review", ["calibration_coverage_below_75_percent", "implausible_reliable_track_count", "no_live_action_detected"])


def test_a_whole_freeze(spark):
    results = spark.createDataFrame([("a", "p", "sideline", "a1", 2, 0.5, 3.0, 9.0), ("b", "q", "endzone", "b1", 1, 0.7, 2.0, 8.0)], "clip_id string, play string, angle string, action_id string, candidate_actions long, selection_cost double, snap_s double, dead_s double")
    skipped = spark.createDataFrame([("c", "tracks are missing"), ("d", "no snap")], "clip_id string, reason string")
    answers = spark.createDataFrame([("a", 10, 100), ("b", 20, 200)], "clip_id string, answer_snap int, answer_rows long")
    inputs = spark.createDataFrame([("a", "m", "h", "s", 3)], "clip_id string, model_version string, config_hash string, sha256 string, calibration_revision int")
    tracks = spark.createDataFrame([("a", "/a", "s1", 7, "h1")], "clip_id string, path string, sha256 string, artifact_id long, config_hash string")
    found = evaluation.Evaluation(results, skipped, answers)
    asked = spark.createDataFrame([("a",), ("c",)], "clip_id string")
    protocol = evaluation.frozen(found, inputs, 1, "v", "{}", requested=asked, tracks=tracks)
    row, = protocol.collect()
    assert (row.clip_id, row.snap_s, row.answer_snap, row.calibration_revision, row.tracks_at_freeze.artifact_id) == ("a", 3.0, 10, 3, 7) and row.frozen_at is not None
    assert [r.clip_id for r in evaluation.skipped_sources(found, asked).collect()] == ["c"]
    document = json.loads(evaluation.protocol_document(protocol.drop("frozen_at"), evaluation.skipped_sources(found, asked)).first().document)
    assert [s["clip_id"] for s in document["sources"]] == ["a"] and document["skipped"] == [{"clip_id": "c", "reason": "tracks are missing"}]
    for wrong in (spark.createDataFrame([("x",)], "clip_id string"), spark.createDataFrame([("c",)], "clip_id string")):
        with pytest.raises(catalog.GateError):
            evaluation.frozen(found, inputs, 1, "v", "{}", requested=wrong)
