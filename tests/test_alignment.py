"""Alignment from listed pairs against the dense program, and the catalog's lists and clips in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.kernels.alignment import align, listed_path, path_cost
from fieldweave.operators import match
from fieldweave.plans import catalog


def test_listed_pairs_give_the_dense_path():
    draw = np.random.default_rng(3)
    for n, m in [(0, 0), (0, 3), (4, 0), (1, 1), (6, 9), (30, 25), (80, 90)]:
        cost = draw.uniform(0, 4, (n, m))
        i, j = np.nonzero(cost <= 1.75)
        rows, columns, price = listed_path(n, m, i, j, cost[i, j], 1.1, 1.1)
        dense = align(cost, 1.1, 1.1, 1.75)
        assert price.sum() == pytest.approx(path_cost(dense, cost, 1.1, 1.1))
        assert [(a, b) for a, b in zip(rows.tolist(), columns.tolist())] == [(a, b) for _, a, b in dense]
        assert sorted(rows[rows >= 0]) == list(range(n)) and sorted(columns[columns >= 0]) == list(range(m))


def test_random_games_equal_the_dense_path(spark):
    draw, plays, units = np.random.default_rng(5), [], []
    kinds = ["run", "pass", "punt", "unknown"]
    for g in range(12):
        plays += [(f"g{g}", i, str(draw.choice(kinds))) for i in range(int(draw.integers(0, 25)))]
        units += [(f"g{g}", i, str(draw.choice(kinds)), float(draw.uniform(2, 14)), float(draw.uniform(0.3, 1))) for i in range(int(draw.integers(0, 25)))]
    p = spark.createDataFrame(plays, "game_id string, ordinal int, kind string")
    u = spark.createDataFrame(units, "game_id string, unit_no int, category string, duration double, confidence double")
    got = {}
    for r in catalog.align_actions(p, u, F.col("kind")).collect():
        got.setdefault(r.game_id, []).append((r.sequence_no, r.i, r.j, r.cost, r.status, r.operation))
    seconds = {"run": 6.0, "pass": 7.5, "punt": 8.0, "unknown": 6.5}
    for g in {r[0] for r in plays + units}:
        a, b = [r for r in plays if r[0] == g], [r for r in units if r[0] == g]
        cost = np.array([[3.0 * (x[2] != y[2] and "unknown" not in (x[2], y[2])) + min(2.5, abs(y[3] - seconds[x[2]]) / seconds[x[2]]) + max(0, 0.7 - y[4]) for y in b] for x in a]).reshape(len(a), len(b))
        steps = align(cost, 1.1, 1.1, 1.75)
        mine = sorted(got[g])
        assert [(i if i is not None else -1, j if j is not None else -1) for _, i, j, *_ in mine] == [(i, j) for _, i, j in steps]
        assert sum(x[3] for x in mine) == pytest.approx(path_cost(steps, cost, 1.1, 1.1))
        assert all(s == ("candidate" if o == "match" and c <= 0.65 else "review") for _, _, _, c, s, o in mine)


def test_keys_that_are_null_and_many_small_keys(spark):
    left = spark.createDataFrame([(None, 0), ("a", 0), ("a", 1), *((f"k{n}", 0) for n in range(300))], "k string, i int")
    right = spark.createDataFrame([("a", 0), *((f"k{n}", 0) for n in range(0, 300, 2))], "k string, j int")
    costs = left.join(right, "k").withColumn("cost", F.col("i") * 0.5 + 0.1)
    got = match.aligned(left, right, costs, ["k"], 1.0, 1.0).collect()
    assert len([r for r in got if r.operation == "match"]) == 151 and len([r for r in got if r.operation == "missing"]) == 152
    assert [(r.operation, r.i) for r in got if r.k is None] == [("missing", 0)]


def test_clips_in_the_order_of_plays(spark):
    plays = spark.createDataFrame([("g", 1, 6.0), ("g", 2, 8.0), ("g", 5, 7.0)], "game_id string, ordinal int, expected double")
    groups = spark.createDataFrame([("g", 1, 6.5), ("g", 2, 40.0), ("g", 3, 7.5), ("g", 4, 7.0)], "game_id string, group_no int, lasted double")
    cost = F.least(F.lit(9.5), F.abs(F.col("lasted") - F.col("expected")))
    got = catalog.align_clips(plays, groups, cost).orderBy("sequence_no").collect()
    assert [(r.operation, r.i, r.j, r.cost) for r in got] == [("match", 0, 0, 0.5), ("match", 1, 2, 0.5), ("match", 2, 3, 0.0)]


def test_what_is_aligned(spark):
    plays = spark.createDataFrame([(1, True, "run"), (2, False, "field_goal"), (3, False, "timeout"), (4, True, None)], "ordinal int, eligible boolean, play_type string")
    assert [sorted(r.ordinal for r in catalog.plays_to_align(plays, every).collect()) for every in (False, True)] == [[1, 4], [1, 2, 4]]


def test_cost_of_a_group_of_sources(spark):
    one = "array<struct<start_s:double,end_s:double,snap_s:double,play_end_s:double,angle:string>>"
    rows = [("run", [(0.0, 20.0, 3.0, 9.0, "sideline"), (20.0, 44.0, 25.0, 33.0, "endzone")]), ("run", [(0.0, 20.0, 3.0, 9.0, "sideline")])]
    got = spark.createDataFrame(rows, f"kind string, sources {one}").select(match.group_cost(F.col("sources"), F.col("kind")).alias("c")).collect()
    assert all(r.c is not None and r.c >= 0 for r in got)
