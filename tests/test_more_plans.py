"""Line families, database tables, ordered examples, read routes and work lists, on values worked out by hand or by plain loops."""

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave import schemas
from fieldweave.operators import match, sample
from fieldweave.plans import catalog, lines
from fieldweave.sources import sqlite
from fieldweave.sources import tables as sources


def families_in_turn(segments, width, height):
    """The best family by trying every direction, straight from its definition."""
    reach, best = max(12.0, 0.03 * math.hypot(width, height)), None
    angle = {i: math.degrees(math.atan2(d - b, c - a)) % 180 for i, a, b, c, d in segments}
    for seed, *_ in segments:
        t = math.radians(angle[seed])
        near = [s for s in segments if min(abs(angle[s[0]] - angle[seed]), 180 - abs(angle[s[0]] - angle[seed])) < 8]
        off = lambda s: (s[2] + s[4]) / 2 * math.cos(t) - (s[1] + s[3]) / 2 * math.sin(t)  # noqa: B023, E731
        groups = []
        for s in sorted(near, key=lambda s: (off(s), s[0])):
            if groups and abs(off(s) - np.mean([off(g) for g in groups[-1]])) <= reach:
                groups[-1].append(s)
            else:
                groups.append([s])
        score = len(groups) ** 2 * np.median([math.hypot(s[3] - s[1], s[4] - s[2]) for s in near])
        if len(groups) >= 2 and (best is None or score > best[0] + 1e-9):
            best = (score, seed, t, groups)
    return best


def test_line_families_across_the_end_of_the_circle(spark):
    draw, frames, rows = np.random.default_rng(7), {}, []
    for frame, lean in enumerate((0.0, 1.0, 179.0, 45.0, 90.0)):
        found = []
        for line in range(4):
            for piece in range(int(draw.integers(1, 4))):
                t = math.radians(lean + float(draw.normal(0, 1.0)))
                x, y = 400 - 120 * line * math.sin(math.radians(lean)) + 90 * piece * math.cos(t), 300 + 120 * line * math.cos(math.radians(lean)) + 90 * piece * math.sin(t)
                ends = (x, y, x + 80 * math.cos(t), y + 80 * math.sin(t))
                found.append((len(found), *(ends if draw.random() < 0.5 else ends[2:] + ends[:2])))
        found.append((len(found), 10.0, 10.0, 10 + 300 * math.cos(math.radians(lean + 60)), 10 + 300 * math.sin(math.radians(lean + 60))))
        frames[frame] = found
        rows += [(frame, *map(float, s[1:]), s[0]) for s in found]
    rows += [(9, 0.0, 0.0, 100.0, 0.0, 0), (9, 5.0, 5.0, 5.0, 5.0, 1)]  # one line, and a point
    df = spark.createDataFrame(rows, "frame int, x1 double, y1 double, x2 double, y2 double, segment_id int").withColumns({"w": F.lit(800), "h": F.lit(600)})
    got = {}
    for r in lines.line_families(df.repartition(4), ["frame"], "w", "h").collect():
        got.setdefault(r.frame, []).append(r)
    assert set(got) == set(frames)
    for frame, segments in frames.items():
        _, _, t, groups = families_in_turn(segments, 800, 600)
        mine = sorted(got[frame], key=lambda r: r.line_no)
        assert [r.pieces for r in mine] == [len(g) for g in groups] and math.isclose(mine[0].angle % 180, math.degrees(t) % 180, abs_tol=1e-9)
        for r, group in zip(mine, groups):
            along = [x * math.cos(t) + y * math.sin(t) for s in group for x, y in (s[1:3], s[3:5])]
            assert math.hypot(r.x2 - r.x1, r.y2 - r.y1) == pytest.approx(max(along) - min(along))
            assert r.x1 * math.cos(t) + r.y1 * math.sin(t) == pytest.approx(min(along))


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "catalog.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "track ing" (game TEXT, frame INTEGER, x REAL, note TEXT)')
        db.executemany('INSERT INTO "track ing" VALUES (?, ?, ?, ?)', [(f"g{i % 3}", i, i / 2, None if i % 5 else "n") for i in range(1000)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    db.close()
    return path


def test_database_tables_prune_and_push(spark, database):
    df = sqlite.sqlite_table(spark, database, "track ing", "game string, frame long, x double", partitions=6)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 1000
    some = df.filter((F.col("game") == "g1") & F.col("frame").between(100, 200) & F.col("game").isin("g1", "g2") & (F.col("x") * 2 > 110))
    assert sorted(r.frame for r in some.collect()) == [i for i in range(111, 201) if i % 3 == 1]
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("Filter ") : plan.index("BatchScan")]
    assert "2.0" in filters and "g1" not in filters  # Spark keeps only what the database can't do
    notes = sqlite.sqlite_table(spark, database, "track ing", "note string")
    assert notes.filter("note is null").count() == 800 and notes.filter("note <=> 'n'").count() == 200
    assert sqlite.sqlite_table(spark, database, "empty", "a long").count() == 0


def test_examples_in_order_and_failed_decoding(spark):
    manifest = spark.createDataFrame([("g", "1", 2.0, 10), ("a", "2", 0.0, 10)], "game_id string, play_id string, snap_s double, snap_frame int")
    labels = spark.createDataFrame([(g, p, f, i) for g, p in (("g", "1"), ("a", "2")) for f in (12, 9, 10) for i in (2, 1)], "game_id string, play_id string, frame_id int, player int")
    examples = sources.paired_examples(manifest, labels, ["game_id", "play_id"])
    seen = [(r.game_id, r.frame_id, [a.player for a in r.answers], frame) for r, frame in sources.ordered_examples(examples, ["game_id", "play_id"], lambda r: f"{r.video_timestamp:.1f}")]
    assert seen == [("a", 10, [1, 2], "0.0"), ("a", 12, [1, 2], "0.2"), ("g", 9, [1, 2], "1.9"), ("g", 10, [1, 2], "2.0"), ("g", 12, [1, 2], "2.2")]
    with pytest.raises(sources.DecodeError, match="g/1 at 1.900s"):
        list(sources.ordered_examples(examples, ["game_id", "play_id"], lambda r: None if r.game_id == "g" else 1))


def test_an_artifact_of_one_clip(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "clip_id string, n int")
    assert sources.of_one_clip(rows.filter("clip_id = 'a'"), "a").count() == 2
    for bad in (rows, rows.limit(0), rows.filter("clip_id = 'b'")):
        with pytest.raises(ValueError):
            sources.of_one_clip(bad, "a")


def test_read_routes_take_the_best_there_is(spark):
    rows = [("new", 0.0, "r", True, True), ("new", 0.0, "s", False, True), ("new", 0.1, "r", True, True), ("new", 0.2, "r", True, None), ("old", 0.0, "t", None, True), ("old", 0.1, "u", None, False), ("oldest", 0.0, "v", None, None)]
    t = spark.createDataFrame(rows, "clip_id string, video_timestamp double, track_id string, roster_candidate boolean, track_reliable boolean")
    shown = lambda **k: sorted((r.clip_id, r.video_timestamp, r.track_id) for r in catalog.shown_tracks(t, **k).collect())
    assert shown() == [("new", 0.0, "r"), ("new", 0.1, "r"), ("new", 0.2, "r"), ("old", 0.0, "t"), ("oldest", 0.0, "v")]
    assert shown(stride=2) == [("new", 0.0, "r"), ("new", 0.2, "r"), ("old", 0.0, "t"), ("oldest", 0.0, "v")]
    assert sample.preferred(t.drop("roster_candidate", "track_reliable"), ["track_reliable"], ["clip_id"]).count() == 7
    with pytest.raises(ValueError):
        catalog.shown_tracks(t, 21)


def table_of(spark, name, rows):
    return schemas.conformed(spark.createDataFrame(rows), name)


@pytest.fixture(scope="module")
def t(spark):
    out = {name: spark.createDataFrame([], schemas.schema(name)) for name in schemas.CATALOG}
    put = lambda name, rows: out.__setitem__(name, table_of(spark, name, rows))
    put("games", [{"game_id": "g", "home": "BUF", "away": "NE", "video_path": "/v"}])
    put("clips", [{"clip_id": c, "game_id": "g", "angle": "sideline", "start_s": s, "end_s": s + 20} for c, s in (("a", 50.0), ("b", 10.0), ("c", 90.0))])
    put("plays", [{"game_id": "g", "ordinal": 1, "description": "d1", "play_type": "run", "yard_line": "BUF 20", "possession": "BUF"}])
    put("play_alignments", [{"play_id": "p1", "game_id": "g", "ordinal": 1}])
    put("play_sources", [{"play_id": "p1", "source_order": 0, "clip_id": "a"}])
    windows = [("a1", "a", 1, 53.0, 60.0, 0.9, "candidate"), ("a2", "a", 2, 65.0, 69.0, 0.2, "verified"), ("b1", "b", 1, 12.0, 17.5, 0.7, "candidate")]
    put("action_windows", [dict(zip(("action_id", "clip_id", "action_order", "snap_s", "dead_s", "confidence", "status"), w)) for w in windows])
    put("action_pairs", [{"pair_id": f"p{a}", "game_id": "g", "primary_action_id": a} for a in ("a2", "b1", "a1")] + [{"pair_id": "x", "game_id": "h", "primary_action_id": "b1"}])
    put("artifacts", [{"artifact_id": n, "kind": "clip_tracks", "clip_id": "a", "path": f"/t{n}"} for n in (3, 8)])
    put("alignment_operations", [{"game_id": "g", "sequence_no": n, "operation": o, "ordinal": p} for n, o, p in ((2, "match", 1), (1, "extra_film", None), (3, "missing_film", 7))])
    return out


def test_calibration_context(t):
    got = {r.clip_id: r for r in catalog.calibration_context(t).collect()}
    assert set(got) == {"a", "b", "c"}
    a = got["a"]
    assert (a.start_s, a.end_s, a.angle, a.video_path, a.yard_line, a.possession, a.play_type, a.snap_s, a.tracks_path) == (50.0, 70.0, "sideline", "/v", "BUF 20", "BUF", "run", 65.0, "/t8")
    assert (got["b"].yard_line, got["b"].snap_s, got["b"].tracks_path, got["c"].snap_s) == (None, 12.0, None, None)


def test_work_list_and_units(t):
    assert [(r.sequence_no, r.operation, r.ordinal, r.description) for r in catalog.alignment_work_list(t, "g").collect()] == [(1, "extra_film", None, None), (2, "match", 1, "d1"), (3, "missing_film", 7, None)]
    assert [(r.pair_id, r.unit_no, r.duration, round(r.confidence, 3)) for r in catalog.filmed_units(t, "g").collect()] == [("pb1", 1, 5.5, 0.7), ("pa1", 2, 7.0, 0.9), ("pa2", 3, 4.0, 0.2)]


def test_team_names(spark, t):
    df = spark.createDataFrame([("g", "home"), ("g", "away"), ("g", "MIA"), ("other", "home"), ("g", None)], "game_id string, team string")
    assert sorted(((r.game_id, r.team) for r in catalog.with_team_names(df, "team", t["games"]).collect()), key=str) == sorted([("g", "BUF"), ("g", "NE"), ("g", "MIA"), ("other", "home"), ("g", None)], key=str)


def test_gate_of_clips(spark):
    rows = [("good", 0.8, 0.9, 22, 1), ("few", 0.8, 0.9, 17, 1), ("off", 0.7, 0.5, 22, 0), ("null", None, 0.9, None, 1)]
    got = {r.clip_id: (r.status, r.reasons) for r in catalog.clip_gate(spark.createDataFrame(rows, "clip_id string, valid_share double, on_field_share double, tracks int, actions int")).collect()}
    assert got == {"good": ("complete", []), "few": ("review", ["track count"]), "off": ("review", ["calibration coverage", "on-field share", "no action"]), "null": ("review", ["calibration coverage", "track count"])}


def test_two_sources_as_one(spark):
    a = spark.createDataFrame([("p", 1, "a", 0.0, 0.0), ("p", 1, "b", 10.0, 0.0), ("p", 2, "a", 1.0, 0.0)], "play string, frame int, track_id string, x double, y double")
    b = spark.createDataFrame([("p", 1, "m", 1.0, 0.0), ("p", 1, "n", 14.0, 0.0), ("p", 3, "m", 5.0, 5.0)], "play string, frame int, track_id string, x double, y double")
    got = sorted((r.frame, r.track_id, r.x, r.y, r.sources) for r in match.fused(a, b, ["play"], "frame").collect())
    assert got == [(1, "a", 0.5, 0.0, 2), (1, "b", 10.0, 0.0, 1), (2, "a", 1.0, 0.0, 1), (3, "m", 5.0, 5.0, 1)]
