"""Trees and proofs against a plain version that holds every level."""

import hashlib
import random
import zlib

import pytest

from fieldweave.llm import merkle_manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(level, arity):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, place, arity):
    out = []
    for level in levels[:-1]:
        first = place // arity * arity
        run = level[first : first + arity]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= arity
    return out


def folded(node, steps):
    for left, right in steps:
        node = sha(left + node + right)
    return node


def plainly(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]], arity)
    top = tree([trees[g][-1][0] for g in order], arity)
    out = []
    for n, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i, arity) + path(top, n, arity)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            start = leaf((*r[:4], r[4] + 1 if hit and r[4] is not None else r[4]))
            root = folded(start, steps)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), root, root == top[-1][0]))
    return sorted(out, key=str)


ROWS = [(i, f"text {i}" * (i % 4), "en" if i % 3 else ["de", "Ä", "zz", None][i % 4], None if i % 11 == 0 else f"s{i % 5}", None if i % 13 == 0 else i) for i in range(90)]
ROWS += [(500, "only", "xx", "s", 1), (501, None, None, None, None), (7, "other text", "en", "s", 2), (7, "same", "en", "s", 2), (7, "same", "en", "s", 2), (None, "no id", "en", "s", 3), (None, "no id", "en", "s", 3), (502, "long " * 50_000, "de", "s", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("arity,block", [(2, 1024), (2, 4), (3, 3), (5, 30)])
def test_whole_audit(spark, arity, block):
    rows = ROWS[:]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 as place", "'x' as tree", "2 as hash")
    got = M.audited(docs, arity=arity, block=block).collect()
    assert sorted(map(tuple, got), key=str) == plainly(ROWS, arity)
    assert {r.verified for r in got} == {True, False}


def test_nodes_and_proofs_by_other_fields(spark):
    rows = [(i, f"t{i}", "g" if i < 5 else "h") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = M.manifest(docs, fields=("text",), block=2)
    leaves = {g: [sha(f"{len(t)}:{t}") for _, t, x in rows if x == g] for g in "gh"}
    trees = {f"1:{g}": tree(v, 2) for g, v in leaves.items()} | {None: tree([tree(leaves[g], 2)[-1][0] for g in "gh"], 2)}
    assert {(r.tree, r.level, r.place): r.hash for r in made.nodes().collect()} == {(g, l, i): h for g, levels in trees.items() for l, level in enumerate(levels) for i, h in enumerate(level)}
    proofs = M.proofs(made).withColumn("end", M.fold(M.F.col("leaf"), M.F.col("path"))).collect()
    assert len(proofs) == 9 and {r.end for r in proofs} == {r.root for r in proofs} == {trees[None][-1][0]}


def test_small_tables(spark):
    docs = spark.createDataFrame(ROWS[:1], SCHEMA)
    one = M.audited(docs).collect()
    assert sorted(map(tuple, one)) == plainly(ROWS[:1], 2) and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")
    assert M.audited(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.manifest(docs, arity=1)


def test_one_group_and_many_groups(spark):
    many = [(i, "t", f"g{i:04}", "s", 1) for i in range(300)] + [(1000 + i, "u", "one", "s", i) for i in range(300)]
    got = M.audited(spark.createDataFrame(many, SCHEMA), block=8).collect()
    assert sorted(map(tuple, got), key=str) == plainly(many, 2)
