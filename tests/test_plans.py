import json

import pytest
from pyspark.sql import functions as F

from fieldweave import schemas
from fieldweave.operators import tracking
from fieldweave.plans import actions, catalog
from fieldweave.sinks import tables as sinks
from fieldweave.sources import tables as sources
from fieldweave.streaming import windows


def pulses(spans):
    rows = []
    for i in range(151):
        t = round(i * 0.2, 1)
        live = any(a <= t <= b for a, b in spans)
        rows += [("c", t, f"t{k}", 10.0 + k, 20.0, 4.0 if live else 0.05) for k in range(12)]
    return rows


def test_actions_are_found_in_pulses(spark):
    clips = spark.createDataFrame([("c", 0.0, 30.0)], "clip_id string, start_s double, end_s double")
    schema = "clip_id string, video_timestamp double, track_id string, field_x double, field_y double, speed double"
    got = actions.discovered(spark.createDataFrame(pulses([(5, 9), (16, 21)]), schema), clips).orderBy("snap_s").collect()
    assert [r.action_order for r in got] == [1, 2] and 4.5 <= got[0].snap_s <= 5.5 and 15.5 <= got[1].snap_s <= 16.5 and got[0].formation_start_s < got[0].snap_s - 2
    assert actions.discovered(spark.createDataFrame(pulses([]), schema), clips).count() == 0


def test_motion_windows_bridge_a_lull_and_survive_a_cut(spark):
    score = lambda i: 30.0 if 30 <= i < 60 else 1.0 + i % 3 * 0.1
    df = spark.createDataFrame([("v", i / 5, score(i), i == 70) for i in range(100)], "k string, timestamp double, score double, camera_cut boolean")
    row, = actions.motion_windows(df, ["k"], 5.0).collect()
    assert 4.5 < row.start < 6.0 and 12.0 < row.end < 13.5
    assert actions.motion_windows(df.limit(5), ["k"], 5.0).count() == 0


def test_play_signature(spark):
    rows = [("g", "1", f, str(p), 10.0 + p * (f - 5), 20.0 + p, 2.0 * (f - 5), {5: "ball_snap", 7: "pass_forward"}.get(f)) for f in (5, 6, 7) for p in range(4)]
    schema = "game_id string, play_id string, frame_id int, player_id string, x double, y double, speed double, event string"
    row = actions.play_signatures(spark.createDataFrame(rows, schema)).first()
    assert row.duration == pytest.approx(0.2) and row.category == "pass" and len(row.speed_profile) == 8 and len(row.formation) == 4 and row.events == ["ball_snap", "pass_forward"]


def test_two_presentations_pair_and_a_third_stays_single(spark):
    base = dict(duration=6.0, displacement=8.0, team_counts=[11.0, 11.0], profile=[1.0, 4.0, 2.0])
    rows = [("g", 1, "a", "c1", "sideline", *base.values()), ("g", 2, "b", "c2", "endzone", *base.values()), ("g", 3, "c", "c3", "sideline", 20.0, 40.0, [2.0, 1.0], [9.0, 0.0, 9.0])]
    df = spark.createDataFrame(rows, "game_id string, position long, action_id string, clip_id string, angle string, duration double, displacement double, team_counts array<double>, profile array<double>")
    assert sorted((r.position, r.partner, r.status) for r in actions.paired_actions(df).collect()) == [(1, 2, "paired"), (3, None, "single")]


def test_alignment_marks_missing_and_extra_film(spark):
    plays = spark.createDataFrame([("g", 1, "run"), ("g", 2, "punt"), ("g", 3, "pass")], "game_id string, ordinal int, kind string")
    units = spark.createDataFrame([("g", 1, "run", 6.0, 0.9), ("g", 2, "pass", 7.5, 0.9), ("g", 3, "kickoff", 9.0, 0.9)], "game_id string, unit_no int, category string, duration double, confidence double")
    got = catalog.align_actions(plays, units, F.col("kind")).orderBy("sequence_no").collect()
    assert [(r.operation, r.i, r.j) for r in got] == [("match", 0, 0), ("missing", 1, None), ("match", 2, 1), ("extra", None, 2)]
    assert [r.status for r in got] == ["candidate", "review", "candidate", "review"]


def tables(spark):
    t = {name: spark.createDataFrame([], schemas.schema(name)) for name in schemas.CATALOG}
    put = lambda name, rows: t.__setitem__(name, schemas.conformed(spark.createDataFrame(rows), name))
    put("games", [{"game_id": "g", "season": 2023, "week": 1}])
    put("plays", [{"game_id": "g", "ordinal": i, "quarter": i % 4 + 1, "description": "d", "play_type": ["run", "pass"][i % 2], "eligible": i % 3 > 0, "source_row_id": str(i)} for i in range(1, 41)])
    put("clips", [{"clip_id": "c1", "game_id": "g", "angle": "sideline", "start_s": 0.0, "end_s": 9.0, "snap_s": 1.0, "play_end_s": 5.0, "confidence": 0.9}])
    put("play_alignments", [{"play_id": "g:1", "game_id": "g", "ordinal": 1, "sideline_clip_id": "c1", "status": "aligned", "score": 1.0}])
    put("play_sources", [{"play_id": "g:1", "source_order": 0, "clip_id": "c1", "angle": "sideline"}])
    put("artifacts", [{"artifact_id": i, "kind": "clip_tracks", "clip_id": "c1", "path": f"p{i}"} for i in (1, 2)])
    put("action_windows", [{"action_id": "a1", "clip_id": "c1", "status": "verified"}, {"action_id": "a2", "clip_id": "c1", "status": "candidate"}])
    return t


def test_catalog_queries(spark):
    t = tables(spark)
    assert catalog.games(t).first().eligible_plays == 27
    queue = catalog.audit_queue(t, "g").collect()
    assert [(r.play_id, r.reasons) for r in queue] == [("g:1", ["1 source; expected 2"])]
    assert catalog.plays(t, "g").filter("processing_status = 'not_aligned'").count() == 26
    assert catalog.shots(t, "g").first().actions == 2 and catalog.latest_artifacts(t, "clip_tracks").first().path == "p2"
    assert catalog.play_detail(t, "g:1").first().sideline_snap_s == 1.0 and catalog.pilot_report(t).first().verified_actions == 1
    assert catalog.audit_summary(t, "g").first().mapping_correct is None
    t["play_alignments"] = t["plays"].select(F.concat(F.lit("g:"), "ordinal").alias("play_id"), "game_id", "ordinal", F.lit("ok").alias("status"))
    chosen = catalog.audit_sample(t, "g", 20)
    assert chosen.count() == 20 and chosen.filter("not eligible").count() == 0 and [r.ordinal for r in chosen.collect()] == sorted(r.ordinal for r in chosen.collect())
    assert catalog.audits_of_sample(t, "g", chosen).filter("selected").count() == 20
    with pytest.raises(ValueError, match="27"):
        catalog.audit_sample(t, "g", 28)


def test_quality_gate(spark):
    good = dict(segmentation_confidence=1.0, alignment_confidence=1.0, track_coverage=1.0, angle_agreement=1.0, identity_confidence=1.0, median_field_error=0.5, p95_field_error=1.0)
    bad = dict.fromkeys(good)
    m = spark.createDataFrame([("p", *good.values()), ("q", *bad.values())], "play_id string, " + ", ".join(f"{k} double" for k in good))
    ids = spark.createDataFrame([(p, team, j) for p in "pq" for team in ("h", "a") for j in range(11) if (p, team, j) != ("q", "h", 3)], "play_id string, team string, jersey int")
    got = {r.play_id: r for r in catalog.quality_gate(m, ids, "play_id").collect()}
    assert got["p"].status == "accepted" and got["q"].status == "rejected" and len(got["q"].reasons) == 8


def test_protocol_fails_closed(spark):
    one = lambda s, **c: spark.createDataFrame([tuple(c.values())], s)
    inputs = "clip_id string, sha256 string, model_version string, config_hash string, calibration_revision int"
    pinned = dict(clip_id="c", sha256="h", model_version="m", config_hash="x", calibration_revision=3)
    answers = one("clip_id string, answer_snap int, answer_rows long", clip_id="c", answer_snap=100, answer_rows=328)
    frozen = catalog.frozen_protocol(one("clip_id string, play_number long", clip_id="c", n=1), one("clip_id string, snap_s double, dead_s double", clip_id="c", a=1.0, b=2.0), one(inputs, **pinned), answers, 1, "v1", "{}")
    now = lambda **change: one(inputs, **(pinned | change)).join(answers, "clip_id")
    assert catalog.checked_protocol(frozen, now(), 1, "v1", "{}").count() == 0
    drift = now(sha256="other")
    with pytest.raises(catalog.GateError, match="drifted"):
        catalog.checked_protocol(frozen, drift, 1, "v1", "{}")
    assert [r.difference for r in catalog.checked_protocol(frozen, drift, 1, "v1", "{}", allow_drift=True).collect()] == ["sha256"]
    for current, version in ((now().withColumn("answer_rows", F.lit(327)), "v1"), (now().limit(0), "v1"), (now(), "v2")):
        with pytest.raises(catalog.GateError):
            catalog.checked_protocol(frozen, current, 1, version, "{}", allow_drift=True)
    with pytest.raises(catalog.GateError):
        catalog.unknown_requests(spark.createDataFrame([("z",)], "clip_id string"), frozen, "clip_id")


def test_projection_and_margins(spark):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    keys = spark.createDataFrame([("c", 1.0, eye, 1.0), ("c", 2.0, eye, 1.0)], "clip_id string, timestamp_s double, matrix array<array<double>>, p95_error double")
    d = spark.createDataFrame([("c", 1.4, 10.0, y) for y in (26.0, -1.5, 55.0, -40.0)] + [("c", 0.5, 10.0, 26.0)], "clip_id string, video_timestamp double, contact_x double, contact_y double")
    got = {(r.video_timestamp, r.contact_y): r for r in tracking.projected(d, keys, ["clip_id"]).collect()}
    assert [got[1.4, y].on_field for y in (26.0, -1.5, 55.0, -40.0)] == [True, True, True, False] and got[1.4, -40.0].out_of_bounds == 40 and got[1.4, 26.0].calibration_valid and not got[0.5, 26.0].calibration_valid


def test_team_split_and_colours(spark):
    x = [46 + 0.3 * i for i in range(11)] + [51 + 0.3 * i for i in range(11)]
    df = spark.createDataFrame([("c", v) for v in x] + [("blob", 50.0 + 0.01 * i) for i in range(22)], "clip_id string, snap_x double")
    row, = tracking.team_split(df, ["clip_id"], "snap_x").collect()
    assert 49 < row.threshold < 52 and row.left == row.right == 11
    colours = [(50.0, 0.0, 0.0, 10.0)] * 5 + [(50.0, 60.0, 60.0, 10.0)] * 5 + [(200.0, 30.0, 30.0, 200.0)] * 2
    rows = spark.createDataFrame([("c", 1.0, *v) for v in colours], "clip_id string, video_timestamp double, lab_l double, lab_a double, lab_b double, hsv_s double")
    roles = tracking.colour_clusters(rows, "clip_id", spark.createDataFrame([("c", 1.0)], "clip_id string, anchor_s double")).groupBy("person_role").count()
    assert {r.person_role: r["count"] for r in roles.collect()} == {"player": 10, "official": 2}


def test_track_roundtrip(spark):
    d = spark.createDataFrame([("c", i / 10, 10.0 + i + 30 * k, 20.0, 0.9) for i in range(5) for k in range(2)], "clip_id string, video_timestamp double, field_x double, field_y double, confidence double")
    got = tracking.tracked(d, "clip_id").groupBy("track_id").count().collect()
    assert sorted((r.track_id, r["count"]) for r in got) == [("c:t1", 5), ("c:t2", 5)]


def test_tracking_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿gameId,playId,frameId,nflId,club,jerseyNumber,x,y,s\n007,1,1.9,,BUF,NA,1.5,nan,\n")
    row = sources.tracking_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.game_id, row.play_id, row.frame_id, row.player_id, row.team, row.jersey_number, row.x, row.y, row.speed, row.event) == ("007", "1", 1, None, "BUF", None, 1.5, None, None, None)
    (tmp_path / "b.csv").write_text("gameId,x\n1,2\n")
    with pytest.raises(ValueError, match="play_id"):
        sources.tracking_csv(spark, str(tmp_path / "b.csv"))


def test_html_plays(spark):
    cell = lambda **c: "<tr>" + "".join(f'<td data-stat="{k}">{v}</td>' for k, v in c.items()) + "</tr>"
    html = '<div><!-- <table id="play_by_play"><tr class="thead"><th data-stat="quarter">Q</th></tr>' + cell(quarter="1", detail="A pass <b>deep</b>") + cell(quarter="", detail="B left end") + cell(quarter="", detail=" ") + cell(quarter="", detail="Timeout") + "</table> --></div>"
    rows = sources.html_plays(spark.createDataFrame([("g", html)], "game_id string, html string"), "game_id", "html").orderBy("ordinal").collect()
    assert [(r.ordinal, r.quarter, r.play_type, r.eligible, r.description) for r in rows] == [(1, 1, "pass", True, "A pass deep"), (2, 1, "run", True, "B left end"), (3, 1, "excluded", False, "Timeout")]


def test_plays_parquet(spark, tmp_path):
    rows = [("s", 2, 1, "9:00", "BUF", 1, 10, "BUF 25", "kick", "kickoff", 0, 0, 0), ("s", 10, 1, " ", "BUF", None, 10, "BUF 25", "pass", "pass", None, 0, 0), ("s", 11, 1, "8:00", "BUF", 2, 5, "BUF 30", "spike", "pass", 0, 1, 0)]
    spark.createDataFrame(rows, "game_id string, play_id int, qtr int, time string, posteam string, down int, ydstogo int, yrdln string, desc string, play_type string, qb_kneel int, qb_spike int, play_deleted int").write.parquet(str(tmp_path / "p"))
    got = sources.plays_parquet(spark, str(tmp_path / "p"), "s", "g").orderBy("ordinal").collect()
    assert [(r.ordinal, r.eligible, r.clock) for r in got] == [(1, False, "9:00"), (2, True, None), (3, False, "8:00")]
    with pytest.raises(ValueError):
        sources.plays_parquet(spark, str(tmp_path / "p"), "other", "g")


def test_write_modes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (None, "n", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(None, None, 3.0), (2, "b", None)], "k int, s string, v double")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(sinks.upserted(old, new, ["k"])) == rows(spark.createDataFrame([(1, "a", 1.0), (None, None, 3.0), (2, "b", None)], old.schema))
    assert len(rows(sinks.inserted_or_ignored(old, new, ["k"]))) == 3
    assert (None, "n", 3.0) in rows(sinks.upserted_filling(old, new, ["k"]))
    assert sinks.next_revision(old, "k") == 2 and sinks.next_revision(old.limit(0), "k") == 1
    path = str(tmp_path / "t")
    sinks.overwrite(old, path)
    sinks.swap_in(sinks.upserted(spark.read.parquet(path), new, ["k"]), path)
    assert spark.read.parquet(path).count() == 3
    m = str(tmp_path / "m")
    for frame in (old, new):
        sinks.upsert_manifest(spark, m, frame, ["k"])
    assert spark.read.schema(old.schema).json(m).count() == 3
    with pytest.raises(ValueError):
        sinks.write_nonempty_manifest(old.limit(0), m)
    ledger = sinks.appended_to_ledger(spark.createDataFrame([(4, "x")], "artifact_id long, kind string"), spark.createDataFrame([("y", 1), ("z", 2)], "kind string, entry int"))
    assert rows(ledger) == [(4, "x"), (5, "y"), (6, "z")]
    assert json.loads(sinks.report_json(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first().json) == {"b": 1}
    with pytest.raises(ValueError):
        sinks.require_outside("/repo/out", ["/repo"])


def test_cascades(spark):
    t = tables(spark)
    left = schemas.without_orphans(t["action_windows"], "action_windows", {"clips": t["clips"].limit(0)})
    assert left.count() == 0 and schemas.without_orphans(t["play_sources"], "play_sources", t).count() == 1
    with pytest.raises(ValueError):
        schemas.require_columns(left, ["nothing"])


def test_streams_equal_batches(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{m}:00", float(m)) for m in (0, 1, 5, 9)]
    df = spark.createDataFrame(rows, "k string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, build in (("bins", lambda s: windows.binned(s, "ts", "2 minutes", "0 seconds", ["k"], "v")), ("sessions", lambda s: windows.sessions(s, "ts", "3 minutes", "0 seconds", ["k"]))):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, build(df).collect()))
