"""Near duplicates by both ways that a size chooses between: the same classes."""

import random

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import dart_minhash as D


def components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {x: v for x, v in label.items()}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    r = random.Random(2)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(500, 500)]
    got = D.connected(spark.createDataFrame(edges, "a long, b long").repartition(3), few=few).collect()
    want = components([e for e in edges if e[0] != e[1]])
    assert {r.id: r.label for r in got} == want and len(got) == len(want)
    assert D.connected(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_classes_by_broadcast_and_by_shuffle(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [[r.choice(words) for _ in range(r.randint(60, 90))] for _ in range(40)]
    for t in texts[:25]:
        copy = t[:]
        copy[r.randrange(len(copy))] = "other"
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    ways = [sorted(map(tuple, D.near_classes(docs, D.NearOptions(most_broadcast=n)).collect())) for n in (10**6, -1)]
    assert ways[0] == ways[1] and sum(1 for x in ways[0] if not x[3]) >= 20
    plan = D.near_classes(docs, D.NearOptions(most_broadcast=-1))
    assert plan.filter(F.col("class_size") > 1).count() >= 40


def test_only_needed_sets_are_shuffled(spark):
    sets = spark.createDataFrame([(i, [i, i + 1]) for i in range(40)], "id long, elements array<long>")
    ids = spark.createDataFrame([(i % 7,) for i in range(30)], "id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, broadcast in ((100, True), (-1, False)):
            got = D._needed(sets, ids, D.NearOptions(most_broadcast=most))
            assert sorted(r.id for r in got.collect()) == list(range(7))
            assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
