"""Medians of the vectors of tracks, trackers on columns, and appearances that go through Python as they are."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from fieldweave.kernels.assignment import assign
from fieldweave.kernels.tracker import Detections, FieldTracker, Track
from fieldweave.operators import aggregate, tracking
from fieldweave.plans import reconstruction


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_middle_vectors_are_medians_of_each_place(spark):
    nan = math.nan
    rows = [("a", "t1", [1.0, 5.0]), ("a", "t1", [2.0, 7.0]), ("a", "t2", [1.0, None]), ("a", "t2", [3.0]), ("a", "t2", None), ("a", "t3", None), ("a", None, [4.0]), ("b", "t1", [nan, 1.0]), ("b", "t1", [2.0, nan]), ("b", "t1", [3.0, 2.0])]
    rows += [("c", f"t{i % 4}", [float(x) for x in np.random.default_rng(i).normal(size=9)]) for i in range(50)]
    df = spark.createDataFrame(rows, "clip_id string, track_id string, v array<double>").repartition(3)
    found = aggregate.middle_vectors(df, ["clip_id"], "track_id", "v", "m")
    want = aggregate.median_vector(df, ["clip_id", "track_id"], "v", "m")
    key = lambda r: (r.clip_id, str(r.track_id))
    assert [repr(tuple(r)) for r in sorted(found.select("clip_id", "track_id", "m").collect(), key=key)] == [repr(tuple(r)) for r in sorted(want.select("clip_id", "track_id", "m").collect(), key=key)]
    assert "Generate" not in plan(found)


def test_tracks_carry_columns_of_any_kind(spark):
    rows = [("a", i, i / 10, 10.0 + i, 5.0, 0.9, [60.0, None] if i == 2 else [60.0, 10.0], {"x": i}, None if i % 2 else "n") for i in range(6)]
    df = spark.createDataFrame(rows, "clip_id string, detection_id long, video_timestamp double, field_x double, field_y double, confidence double, appearance array<double>, more map<string,int>, note string")
    made = tracking.tracked(df.withColumn("pair", F.struct("note", F.array(F.lit(1)))), "clip_id")
    assert "FlatMapGroupsInArrow" in plan(made)
    found = made.orderBy("detection_id").collect()
    assert [(r.detection_id, r.appearance, r.more, r.note, r.track_id) for r in found] == [(r[1], r[6], r[7], r[8], "a:t1") for r in rows]


def test_appearances_without_an_embedding_are_short_until_the_end(spark):
    rows = [("a", t / 10, float(10 * k), 5.0, 0.9, 60.0 + 90 * (k % 2), True, True) for t in range(30) for k in range(4)]
    df = spark.createDataFrame(rows, "clip_id string, video_timestamp double, field_x double, field_y double, confidence double, lab_l double, on_field boolean, calibration_valid boolean")
    df = df.withColumns({"lab_a": F.lit(10.0), "lab_b": F.lit(10.0), "hsv_s": F.lit(20.0)})
    assert reconstruction.with_looks(df).select(F.max(F.size("appearance"))).first()[0] == 6
    assert reconstruction.with_looks(df.withColumn("emb_03", F.lit(1.0))).select(F.max(F.size("appearance"))).first()[0] == 70
    clips = spark.createDataFrame([("a", "sideline", 0.0, 3.0)], "clip_id string, angle string, start_s double, end_s double")
    found = reconstruction.reconstructed(df, clips).collect()
    assert len(found) == 120 and {len(r.appearance) for r in found} == {70} and {tuple(r.appearance[6:]) for r in found} == {(0.0,) * 64}


def test_tracker_takes_up_listed_tracks():
    start = [Track(3, np.array([1.0, 2.0]), np.zeros(2), 0.0, 0.9, "unknown", None, None)]
    tracker = FieldTracker(tracks=start, next_id=4)
    ids = tracker.update(Detections(0.1, np.array([[50.0, 9.0], [1.1, 2.0], [80.0, 3.0]]), np.array([0.7, 0.9, 0.8]), ["team_0", "team_1", "unknown"]))
    assert ids.tolist() == [5, 3, 4] and [(t.id, t.team, t.missed) for t in tracker.tracks] == [(3, "team_1", 0), (4, "unknown", 0), (5, "team_0", 0)]


def test_assign_with_and_without_conflicts():
    rng = np.random.default_rng(5)
    for n, m in [(1, 1), (1, 5), (3, 3), (3, 6), (5, 2), (4, 6)] * 20:
        cost = np.where(rng.random((n, m)) < 0.3, 1e6, rng.random((n, m)))
        a, b = assign(cost)
        short, whole = (cost, m) if n <= m else (cost.T, n)
        least = min(sum(short[i, p[i]] for i in range(len(short))) for p in itertools.permutations(range(whole), len(short)))
        assert len(a) == min(n, m) and len(set(a.tolist())) == len(set(b.tolist())) == len(a) and math.isclose(cost[a, b].sum(), least)
        assert a.tolist() == sorted(a.tolist())
