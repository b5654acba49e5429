"""Chains of greedy choices against plain loops; one key of many rows is many tasks and no Python."""

import numpy as np
from pyspark.sql import functions as F

from fieldweave.operators import chains, ranks
from fieldweave.sinks import lineage


def kept_in_turn(rows, least):
    out, last = [], {}
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if k not in last or t - last[k] >= least:
            out.append((k, t, i))
            last[k] = t
    return sorted(out, key=str)


def test_min_separation(spark):
    draw, rows = np.random.default_rng(4), []
    for k, n in (("a", 400), ("b", 1), (None, 30), ("c", 2)):
        rows += [(k, float(t), i) for i, t in enumerate(np.sort(draw.integers(0, 40 * n, n) / 4 + np.arange(n) / 1024))]
    rows += [("d", 1.0 + i / 1024, i) for i in range(200)]  # all within the distance
    df = spark.createDataFrame([*rows, ("a", None, 9)], "k string, t double, i int").repartition(4)
    for least in (2.0, 16.0):
        got = chains.min_separation(df, ["k"], "t", least)
        assert got.columns == ["k", "t", "i"] and sorted(map(tuple, got.collect()), key=str) == kept_in_turn(rows, least)
    assert chains.min_separation(df.limit(0), ["k"], "t", 1.0).count() == 0
    assert chains.min_separation(spark.createDataFrame([("x", 1.0), ("x", 1.0)], "k string, t double"), ["k"], "t", 0.5).count() == 1


def test_one_key_of_many_rows_is_many_tasks_without_python(spark):
    n = 50_000
    df = spark.range(n).select(F.lit("one").alias("k"), (F.col("id") * 7 % n).cast("double").alias("t"))
    got = chains.min_separation(df, ["k"], "t", 5.0)
    assert [r.t for r in got.orderBy("t").collect()] == [5.0 * i for i in range(n // 5)]
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    scratch = lineage.Scratch(spark)
    ranks.ranked(df, ["k"], [F.col("t")], scratch=scratch)
    assert max(r["count"] for r in scratch.tables[0].groupBy(F.input_file_name()).count().collect()) < n / 2


def fragments_in_turn(rows, touch, short):
    out, group, begin, before = {}, -1, 0.0, None
    for start, end, kind in sorted(rows):
        joins = before is not None and kind == before[2] and abs(start - before[1]) < touch and (before[1] - begin <= short or end - start <= short)
        if not joins:
            group, begin = group + 1, start
        before = (start, end, kind)
        out[start] = group
    return out


def test_fragments(spark):
    draw, rows = np.random.default_rng(6), []
    for k in range(6):
        at = 0.0
        for _ in range(int(draw.integers(1, 60))):
            end = at + float(draw.choice([1.0, 2.0, 4.0, 8.0]))
            rows.append((f"k{k}", at, end, str(draw.choice(["x", "y"], p=[0.9, 0.1]))))
            at = end + float(draw.choice([0.0, 0.0, 0.0, 0.03125, 1.0]))
    df = spark.createDataFrame(rows, "k string, a double, b double, kind string").repartition(3)
    got = chains.coalesced(df, ["k"], "a", "b", "kind").collect()
    want = {k: fragments_in_turn([r[1:] for r in rows if r[0] == k], 0.05, 5.0) for k in {r[0] for r in rows}}
    assert len(got) == len(rows) and all(r.part == want[r.k][r.a] for r in got)
    assert chains.coalesced(df.limit(0), ["k"], "a", "b", "kind").count() == 0
