"""Ranks, quantiles and samples against numpy and plain sorting; groups that hold all rows are cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import aggregate, ranks, sample
from fieldweave.sinks import lineage


@pytest.fixture(scope="module")
def rows(spark):
    draw, out = np.random.default_rng(1), []
    for k, n in (("one", 3000), ("few", 7), (None, 40), ("single", 1), ("none", 5)):
        for i in range(n):
            value = None if k == "none" or draw.random() < 0.1 and k != "single" else float(np.round(draw.normal(0, 3), 1))
            out.append((k, i, value, float(draw.integers(0, 4))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, v double, w double").repartition(5)


def of(rows, key, column):
    return np.array([r[column] for r in rows if r[0] == key and r[column] is not None])


def test_ranks_and_sizes(df, rows):
    got = ranks.ranked(df, ["k"], [F.col("i")]).collect()
    assert len(got) == len(rows) and all(r.rank == r.i and r.size == len([1 for x in rows if x[0] == r.k]) for r in got)


def test_weighted_ranks(df, rows):
    got = {(r.k, r.i): (r.rank, r.size) for r in ranks.ranked(df, ["k"], [F.col("i").desc()], weight="w").collect()}
    for k, i, _, _ in rows:
        own = {r[1]: int(r[3]) for r in rows if r[0] == k}
        assert got[k, i] == (sum(w for j, w in own.items() if j > i), sum(own.values()))


def test_rows_that_all_tie_have_all_ranks_and_are_cut(spark):
    same = spark.range(4000).select(F.lit("a").alias("k"), F.lit(1).alias("v")).repartition(4)
    ranked = ranks.ranked(same, ["k"], [F.col("v")])
    assert sorted(r.rank for r in ranked.collect()) == list(range(4000))
    scratch = lineage.Scratch(spark)
    ranks.ranked(same, ["k"], [F.col("v")], scratch=scratch)
    sizes = [r["count"] for r in scratch.tables[0].groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_exact_quantiles(df, rows):
    wanted = {"middle": ("v", 0.5), "low": ("v", 0.0), "high": ("v", 1.0), "p35": ("v", 0.35), "w90": ("w", 0.9)}
    got = {r.k: r for r in ranks.exact_quantiles(df, ["k"], wanted).collect()}
    assert set(got) == {"one", "few", None, "single", "none"}
    for k, r in got.items():
        for name, (c, q) in wanted.items():
            values = of(rows, k, {"v": 2, "w": 3}[c])
            assert r[name] == (pytest.approx(np.quantile(values, q), abs=1e-12) if len(values) else None)
    whole = ranks.exact_quantiles(df, [], {"m": ("v", 0.5)}).collect()
    assert [r.m for r in whole] == [pytest.approx(np.median([r[2] for r in rows if r[2] is not None]))]
    assert ranks.exact_quantiles(df.limit(0), ["k"], {"m": ("v", 0.5)}).count() == 0


def test_one_group_of_all_rows_is_many_tasks(spark):
    values = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    plain = np.arange(20_000) * 7919 % 20_011
    scratch = lineage.Scratch(spark)
    ranks.ranked(values, ["k"], [F.col("v")], scratch=scratch)
    assert max(r["count"] for r in scratch.tables[0].groupBy(F.input_file_name()).count().collect()) < 10_000
    got = ranks.exact_quantiles(values, ["k"], {"a": ("v", 0.5), "b": ("v", 0.123)}).first()
    assert (got.a, got.b) == (pytest.approx(np.quantile(plain, 0.5)), pytest.approx(np.quantile(plain, 0.123)))


def test_plans_hold_no_group(df):
    """No aggregate that keeps a group's values, and no window over a whole group."""
    plan = ranks.exact_quantiles(df, ["k"], {"m": ("v", 0.5)})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    sampled = sample.stratified_middle_out(df, ["k"], "i", 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in sampled and "windowspecdefinition(k" in sampled  # over the runs of a key
    assert "row_number" not in sampled


def test_summaries(df, rows):
    got = {r.k: r for r in aggregate.error_summary(df, ["k"], "v", 1.0).collect()}
    for k in ("one", None, "none"):
        v, n = of(rows, k, 2), len([1 for r in rows if r[0] == k])
        assert (got[k].matched, got[k].total, got[k].coverage) == (len(v), n, pytest.approx(len(v) / n))
        assert got[k].near_share == pytest.approx((v <= 1).sum() / n) and got[k].p90 == (pytest.approx(np.quantile(v, 0.9)) if len(v) else None)
    got = {r.k: r for r in aggregate.robust_scale(df, ["k"], "v", (0.35,)).collect()}
    v = of(rows, "one", 2)
    assert got["one"].mad == pytest.approx(np.median(abs(v - np.median(v)))) and got["single"].mad == 1.0 and got["none"].mad is None


def test_formation_takes_the_nearest(df, rows):
    got = {r.k: r.formation for r in aggregate.formation(df.filter("v is not null"), ["k"], "v", "w", most=4).collect()}
    v, w = (np.array([r[c] for r in rows if r[0] == "one" and r[2] is not None]) for c in (2, 3))
    assert got["one"] == pytest.approx(sorted(np.hypot(v - np.median(v), w - np.median(w)))[:4]) and len(got["single"]) == 1


def test_samples_across_groups(spark):
    rows = [(g, s, i) for g, sizes in (("a", (5, 1)), ("b", (2, 2))) for s, n in enumerate(sizes) for i in range(n)]
    got = sample.stratified_middle_out(spark.createDataFrame(rows, "g string, s int, i int"), ["s"], "i", 3, across=["g"]).collect()
    assert sorted((r.g, r.turn, r.s, r.i) for r in got) == [("a", 0, 0, 2), ("a", 0, 1, 0), ("a", 1, 0, 3), ("b", 0, 0, 1), ("b", 0, 1, 1), ("b", 1, 0, 0)]


def test_tables_on_the_way_go(spark):
    made = lineage.written(spark.range(10).toDF("x"), "t")
    folder = lineage._path(spark, made.inputFiles()[0])
    assert made.count() == 10 and folder[1].exists(folder[0].getParent())
    lineage.dropped(spark, made)
    assert not folder[1].exists(folder[0].getParent().getParent())
