"""Mutual nearest vectors against all pairs, for vectors with and without clusters; what is compared is counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.operators import nearest
from fieldweave.sinks.lineage import Scratch


def by_all_pairs(left, right, ratio):
    out = set()
    for k in {r[0] for r in left}:
        a, b = [r for r in left if r[0] == k and r[2]], [r for r in right if r[0] == k and r[2]]
        if not a or not b:
            continue
        d = np.sqrt(((np.array([r[2] for r in a])[:, None] - np.array([r[2] for r in b])[None]) ** 2).sum(2))
        for i, row in enumerate(d):
            order = sorted(range(len(b)), key=lambda j: (row[j], b[j][1]))
            j = order[0]
            back = min(range(len(a)), key=lambda x: (d[x, j], a[x][1]))
            if back == i and (len(order) < 2 or row[j] < ratio * row[order[1]]):
                out.add((k, a[i][1], b[j][1], round(float(row[j]), 9)))
    return out


def tables(spark, left, right):
    return (spark.createDataFrame(x, "k string, id long, v array<double>").repartition(3) for x in (left, right))


def clustered(draw, n, keys, dims=6, clusters=9, spread=0.02):
    centres = np.random.default_rng(99).uniform(0, 10, (clusters, dims))  # the same for both sides
    return [(str(draw.choice(keys)), i, (centres[draw.integers(clusters)] + draw.normal(0, spread, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "sphere", "one label"])
def test_as_all_pairs(spark, kind):
    draw = np.random.default_rng(3)
    if kind == "sphere":
        make = lambda n: [(str(draw.choice(["x", "y"])), i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(draw.normal(0, 1, (n, 16)))]
    else:
        make = lambda n: clustered(draw, n, ["x", "y"] if kind == "clusters" else ["all"])
    left, right = make(230), make(260)
    left += [("x", 900, None), ("alone", 901, left[0][2]), (None, 902, left[0][2])]
    right += [(None, 903, left[0][2]), ("x", 950, left[3][2]), ("x", 951, left[3][2])]  # ties
    for ratio in (0.98, 2.0):
        got = nearest.mutual_nearest(*tables(spark, left, right), ["k"], "id", "v", ratio, pivots=12, block=16).collect()
        assert {(r.k, r.left_id, r.right_id, round(r.distance, 9)) for r in got} == by_all_pairs(left, right, ratio) and len(got) > 3


def test_few_blocks_of_clusters_meet(spark):
    draw = np.random.default_rng(5)
    rows = clustered(draw, 1500, ["all"], clusters=20)
    df = spark.createDataFrame(rows, "k string, id long, v array<double>")
    scratch, seen = Scratch(spark), []
    plain = nearest._compared

    def counting(pairs, blocks, key):
        n = blocks.select("side", "cell", "block", "n")
        a, b = (n.filter(f"side = {s}").select(F.col("cell").alias(c), F.col("block").alias(p), F.col("n").alias(x)) for s, c, p, x in ((0, "cell", "block", "na"), (1, "other_cell", "other_block", "nb")))
        seen.append(pairs.join(a, ["cell", "block"]).join(b, ["other_cell", "other_block"]).agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0)
        return plain(pairs, blocks, key)

    nearest._compared = counting
    try:
        nearest.mutual_nearest(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["k"], "id", "v", pivots=60, block=32)
    finally:
        nearest._compared = plain
    assert sum(seen) < 0.35 * 750 * 750
    scratch.cleared()
