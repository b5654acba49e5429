"""Queries on odd values and at shapes that once went wrong, against their SQL or against plain versions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldweave.kernels import alignment
from fieldweave.operators import aggregate, match, metrics, tracking
from fieldweave.queries.registry import QUERIES, SQL


def by_sql(name, folder, *tables):
    with duckdb.connect() as c:
        for t in tables:
            c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return c.execute(SQL[name]).fetchall()


def by_spark(spark, name, folder):
    return [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]


def test_words_end_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["la leé", "éthe", "ofß 12", "dieñ x", "ünder", "_de", "de_", "le9", "café de", "Öle", "THE end 7", "", None, " \n of\n", "theatre", "été", "ме de", "чde"]
    pd.DataFrame({"conv_id": range(len(texts)), "turn": 0, "role": "user", "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    found = by_spark(spark, "classify_text", tmp_path)
    assert {r[2] for r in found if r[0] in (0, 1, 2, 3)} == {"fr", "en", "de"}
    assert sorted(found) == sorted(by_sql("classify_text", tmp_path, "conversations"))


def test_names_of_tags_end_beside_letters_beyond_ascii(spark, tmp_path):
    html = ["<ul><li>a</li><lié>b</li><link>c</li><li class='x'>d <b>e</b></li></ul>", "<!-- <li>x</li> --><li><a href=\"u\">v</a></li>", ""]
    pd.DataFrame({"page_id": range(len(html)), "url": "u", "html": html}).to_parquet(tmp_path / "pages.parquet")
    found = by_spark(spark, "html_items", tmp_path)
    assert [r[2] for r in sorted(found)] == ["a", "b", "d e", "v"]
    assert sorted(found) == sorted(by_sql("html_items", tmp_path, "pages"))


@pytest.mark.parametrize("operator", [lambda t: tracking.with_roster(t, "clip_id"), lambda t: match.chained(match.relinked(t, ["clip_id"]), ["clip_id"])])
def test_tracks_are_made_once(spark, operator):
    """What makes the tracks may take long: an operator that reads them several times keeps them."""
    taken = spark.sparkContext.accumulator(0)

    def made(parts):
        for part in parts:
            taken.add(len(part))
            yield part

    rows = [("c", f"t{i % 3}", i / 10, float(i), 5.0, 0.1, 0.0, 0.1, "team_0", "player", False, 0.9, 1.0, 2.0, [0.5]) for i in range(30)]
    schema = "clip_id string, track_id string, video_timestamp double, field_x double, field_y double, vx double, vy double, speed double, team string, person_role string, crowd_burst boolean, confidence double, width double, height double, appearance array<double>"
    assert operator(spark.createDataFrame(rows, schema).mapInPandas(made, schema)).count() == 30
    assert taken.value == 30


def test_union_of_intervals_takes_more_tasks_as_rows_grow(spark):
    """A task holds about half a million rows, however many there are."""
    rows = spark.range(16_000_000).selectExpr("id % 4000000 as k", "id div 4000000 * 2.0D as a", "id div 4000000 * 2.0D + 1.5D as b")
    found = aggregate.covered_length(rows, ["k"], "a", "b")
    assert found.rdd.getNumPartitions() == 32
    few = aggregate.covered_length(rows.filter("k < 5"), ["k"], "a", "b").collect()
    assert {(r.k, r.length, r.parts, r.cover) for r in few} == {(k, 6.0, 4, 0.8) for k in range(5)}


def test_hota_makes_no_rows_of_pairs(spark):
    """Pairs of a frame are made in the clip's own task: none is dealt out or sorted as a row."""
    truth = spark.createDataFrame([("c", f, f"p{i}", float(9 * i), 1.0) for f in range(3) for i in range(4)], "clip_id string, frame_id long, label string, x double, y double")
    tracks = truth.selectExpr("clip_id", "frame_id", "concat('t', label) as track_id", "x as field_x", "y as field_y")
    alone = tracks.selectExpr("'d' as clip_id", "frame_id", "track_id", "field_x", "field_y")
    found = metrics.hota(truth, tracks.unionByName(alone), ["clip_id"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.clip_id, r.gt_dets, r.pr_dets, r.HOTA, r.AssA) for r in found.collect()} == {("c", 12, 12, 1.0, 1.0), ("d", 0, 12, 0.0, 0.0)}


def test_short_sequences_are_aligned_without_diagonals(monkeypatch):
    """Short games take plain numbers, and every step is that of the diagonals, of ties too."""
    rng, games = np.random.default_rng(5), []
    for _ in range(200):
        n, m = rng.integers(0, 14, 2)
        row, column = np.nonzero(rng.random((n, m)) < 0.4)
        games.append((n, m, row, column, rng.choice([0.2, 0.5, 1.0, 1.1, 2.2], len(row)), 1.1, 1.1))
    with monkeypatch.context() as m:
        m.setattr(alignment, "FEW_PLACES", 0)
        expected = [alignment.listed_path(*g) for g in games]
    monkeypatch.setattr(alignment, "_diagonal_steps", None)
    for found, steps in zip(map(lambda g: alignment.listed_path(*g), games), expected):
        assert all(np.array_equal(a, b) for a, b in zip(found, steps))
