import random

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import aggregate, joins, sample
from fieldweave.operators import sequence as seq


def grown(high, low, cut):
    """The sequential rule: each seed grows both ways through low samples and stops at cuts."""
    on = list(high)
    for i, h in enumerate(high):
        if h:
            for step in (-1, 1):
                j = i + step
                while 0 <= j < len(low) and low[j] and not cut[j]:
                    on[j] = True
                    j += step
    return on


def bridged(flags, limit):
    flags = list(flags)
    for i in range(1, len(flags)):
        if not flags[i] and flags[i - 1] is not None:
            before, after = any(flags[max(0, i - limit) : i]), any(flags[i + 1 : i + 1 + limit])
            if before and after:
                flags[i] = True
    return flags


def test_hysteresis_equals_the_sequential_rule(spark):
    r = random.Random(3)
    rows, want = [], {}
    for key in range(60):
        n = r.randint(1, 14)
        v, cut = [r.random() for _ in range(n)], [r.random() < 0.2 for _ in range(n)]
        rows += [(key, i, v[i], cut[i]) for i in range(n)]
        want |= {(key, i): x for i, x in enumerate(grown([x > 0.8 for x in v], [x > 0.4 for x in v], cut))}
    df = spark.createDataFrame(rows, "k int, i int, v double, cut boolean")
    got = seq.hysteresis(df, ["k"], "i", F.col("v") > 0.8, F.col("v") > 0.4, F.col("cut")).collect()
    assert {(r.k, r.i): r.active for r in got} == want


@pytest.mark.parametrize("gap, limit, filled", [(3, 3, 3), (4, 3, 3), (5, 3, 3), (6, 3, 0), (7, 5, 5), (10, 5, 0)])
def test_count_bridging(spark, gap, limit, filled):
    flags = [True] + [False] * gap + [True, False]
    got = seq.bridged_by_count(spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean"), ["k"], "i", "f", limit).orderBy("i").collect()
    assert [r.f for r in got] == [True] + [False] * (gap - filled) + [True] * filled + [True, False]


def test_time_bridging_keeps_ends_and_long_gaps(spark):
    df = spark.createDataFrame([(0, t, f) for t, f in zip([0.0, 0.5, 1.0, 1.5, 2.0, 4.0, 5.0], [False, True, False, True, False, False, True])], "k int, t double, f boolean")
    assert [r.f for r in seq.bridged_by_time(df, ["k"], "t", "f", 0.8).orderBy("t").collect()] == [False, True, True, True, False, False, True]


def test_rolling_frames(spark):
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([1, 2, 30, 4, 5])], "k int, i int, v double")
    got = df.select("i", seq.rolling_mean("v", ["k"], "i", 2).alias("m"), seq.rolling_median("v", ["k"], "i", 3).alias("d"), seq.box_mean("v", ["k"], "i").alias("b")).orderBy("i").collect()
    assert [r.m for r in got] == [1, 1.5, 16, 17, 4.5] and [r.d for r in got] == [1.5, 2, 4, 5, 4.5] and got[0].b == pytest.approx(33 / 5)


def test_session_groups_open_on_every_opener(spark):
    clips = [("e0", "endzone"), ("s1a", "sideline"), ("s1b", "sideline"), ("e1a", "endzone"), ("x", "other"), ("e1b", "endzone"), ("s2", "sideline"), ("e2", "endzone")]
    df = spark.createDataFrame([("g", i, c, a) for i, (c, a) in enumerate(clips)], "g string, i int, c string, a string")
    got = seq.session_groups(df, ["g"], "i", F.col("a") == "sideline", F.col("a") == "endzone").groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("group_order", "c")))["c"].alias("c")).orderBy("group_no").collect()
    assert [r.c for r in got] == [["s1a"], ["s1b", "e1a", "e1b"], ["s2", "e2"]]


def test_sustained_onset_and_rest(spark):
    v = [0, 0, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, i int, v int")
    row = seq.sustained(df, ["k"], "i", F.col("v") == 1, 3, F.col("v") == 0, F.lit(4)).first()
    assert (row.start, row["end"]) == (4, 8)


def test_nearest_in_time_takes_the_earlier_of_equals(spark):
    left = spark.createDataFrame([("c", 1.4), ("c", 1.5), ("c", 9.0), ("d", 0.0)], "k string, t double")
    right = spark.createDataFrame([("c", 1.0, "a"), ("c", 2.0, "b")], "k string, at double, m string")
    got = joins.nearest_in_time(left, right, ["k"], "t", "at", ["m"], valid_within=0.75).orderBy("k", "t").collect()
    assert [(r.m, r.valid) for r in got] == [("a", True), ("a", True), ("b", False), (None, False)]


def test_middle_out_sample_equals_popping_the_middle(spark):
    for n in (1, 2, 5, 8):
        df = spark.createDataFrame([("s", i) for i in range(n)], "s string, i int")
        left, want = list(range(n)), []
        while left:
            want.append(left.pop(len(left) // 2))
        assert [r.i for r in sample.stratified_middle_out(df, ["s"], "i", n).orderBy("turn").collect()] == want


def test_profile_has_no_gaps(spark):
    df = spark.createDataFrame([("p", 0.0, 1.0), ("p", 1.0, 3.0), ("p", 8.0, 9.0), ("q", 5.0, None)], "k string, t double, v double")
    got = {r.k: r.profile for r in aggregate.binned_profile(df, ["k"], "t", "v").collect()}
    assert got["p"][0] == 1 and got["p"][1] == 3 and got["p"][7] == 9 and got["p"][4] == pytest.approx(6) and got["q"] == [0.0] * 8
