"""Streams of detections whose frames are split and late, against the tracker of complete clips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import tracking
from fieldweave.streaming.tracker import tracked_stream

SCHEMA = "clip_id string, video_timestamp double, field_x double, field_y double, confidence double, team string, x1 double, y1 double, x2 double, y2 double"


def detections(n_frames=40, seed=3):
    draw, rows = np.random.default_rng(seed), []
    for clip in ("a", "b"):
        start, move = draw.uniform(10, 100, (9, 2)), draw.normal(0, 2, (9, 2))
        for f in range(n_frames):
            for i in range(9):
                if draw.random() < 0.85:
                    x, y = start[i] + move[i] * f / 10 + draw.normal(0, 0.1, 2)
                    rows.append((clip, f / 10, float(x), float(y), float(draw.uniform(0.2, 1)), "team_0" if i < 4 else "unknown", 0.0, 0.0, 10.0 + i, 20.0))
    return rows


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def streamed(spark, folder, parts, name, **options):
    """What comes out when the parts are read one by one, and a row of another clip far ahead closes all frames."""
    for i, part in enumerate([*parts, [("end", 900.0, 1.0, 1.0, 1.0, "unknown", 0.0, 0.0, 1.0, 1.0)], [("end", 2000.0, 1.0, 1.0, 1.0, "unknown", 0.0, 0.0, 1.0, 1.0)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        if i == 0:
            rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
            rows = rows.withColumn("at", F.timestamp_millis(F.lit(1_700_000_000_000) + F.round(F.col("video_timestamp") * 1000).cast("long")))
            q = tracked_stream(rows, "clip_id", "at", **options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(folder / "checkpoint")).outputMode("append").start()
        q.processAllAvailable()
    progress = q.lastProgress
    q.stop()
    return spark.table(name), progress


def test_split_and_late_frames_give_the_batch_result(spark, tmp_path, store):
    rows = detections()
    batch = tracking.tracked(spark.createDataFrame(rows, SCHEMA), "clip_id")
    r = random.Random(1)
    dealt = [[] for _ in range(8)]
    for row in rows:  # a frame's rows are in the micro-batch of its half second, or in the next two
        dealt[min(7, int(row[1] / 0.5) + r.randint(0, 2))].append(row)
    for part in dealt:
        r.shuffle(part)
    got, _ = streamed(spark, tmp_path, [p for p in dealt if p], "split_tracks", late="2 seconds", silence_s=30.0)
    key = ["clip_id", "video_timestamp", "field_x", "field_y", "track_id", "team", "crowd_burst"]
    assert sorted(map(tuple, got.filter("clip_id <> 'end'").select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    velocity = {(r.clip_id, r.video_timestamp, r.field_x): (r.vx, r.vy) for r in batch.collect()}
    assert all((r.vx, r.vy) == pytest.approx(velocity[r.clip_id, r.video_timestamp, r.field_x]) for r in got.filter("clip_id <> 'end'").collect())


def test_a_silent_clip_gives_its_state_back_and_late_rows_are_left_out(spark, tmp_path, store):
    first = [("a", f / 10, 10.0 + f / 10, 20.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0) for f in range(5)]
    far = [("b", 100.0, 1.0, 1.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0)]
    further = [("b", 130.0, 1.0, 1.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0)]
    late = [("a", 0.7, 10.7, 20.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0), ("a", 131.0, 50.0, 20.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0), ("a", 131.1, 50.1, 20.0, 0.9, "unknown", 0.0, 0.0, 5.0, 9.0)]
    got, progress = streamed(spark, tmp_path, [first, far, further, late], "silent_tracks", late="1 second", silence_s=20.0)
    rows = sorted((r.video_timestamp, r.track_id) for r in got.filter("clip_id = 'a'").collect())
    # Ids of the clip begin anew, as its state had gone; the row of 0.7 s came too late.
    assert rows == [(0.0, "a:t1"), (0.1, "a:t1"), (0.2, "a:t1"), (0.3, "a:t1"), (0.4, "a:t1"), (131.0, "a:t1"), (131.1, "a:t1")]
    assert progress["stateOperators"][0]["numRowsTotal"] <= 8  # of the last clip alone
