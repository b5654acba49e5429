"""The rope and the transformation against plain slicing of the units."""

import hashlib
import random
import re

import pytest

from fieldweave.llm import fim_rope as R

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def by_slices(doc_id, text, o=R.FimOptions()):
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"{o.seed}:{doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or c % 100 >= o.rate:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    form = "spm" if d % 100 < o.spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    r = random.Random(4)
    texts = ["", " ", "\n \t", "a", " a", "a ", "<", "a <S", "x<P>y", "M>", "é ü \x85 z\x1c", "🙂 " * 900, "word " * 5000 + "\n\n", "y" * 20_000]
    texts += ["".join(r.choice(["a", "ß", " ", "\n", "<", "P", ">", "日"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    return texts + [" ".join("w" * r.randint(1, 9) for _ in range(r.randint(200, 1500))) for _ in range(20)]


def test_transformed_and_restored(spark):
    rows = list(enumerate(some_texts())) + [(900, None), (901, "twice here"), (901, "twice here")]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, form string").repartition(3)
    made = R.restored(R.transformed(docs))
    got = made.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_slices(r.doc_id, r.text or "") and r.restored == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sums = {r.doc_id: (r.output_sha256, r.restored_sha256) for r in R.round_trip(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(sums[r.doc_id] == (sha(r.output), sha(r.text or "")) for r in got)


def test_rows_without_an_id_and_an_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two three"), (None, None)], "doc_id long, text string")
    got = {r.text: r for r in R.restored(R.transformed(docs, R.FimOptions(rate=100)), R.FimOptions(rate=100)).collect()}
    assert got["one two three"].restored == "one two three" and got["one two three"].form != "plain"
    assert (got[None].n, got[None].form, got[None].output, got[None].restored) == (0, "plain", "", "")
    assert R.transformed(docs.limit(0)).count() == 0 and R.round_trip(docs.limit(0)).columns[0] == "doc_id"


def height_bound(rope):
    """Of a rope whose neighbours' heights differ by two at most."""
    if rope.left is None:
        return True
    assert (rope.units, rope.chars) == (rope.left.units + rope.right.units, rope.left.chars + rope.right.chars)
    return abs(rope.left.height - rope.right.height) <= 2 and height_bound(rope.left) and height_bound(rope.right)


def test_splits_share_subtrees_and_stay_balanced():
    text = " ".join(f"w{i}" for i in range(40_000))
    rope, r = R.rope_of_units(text), random.Random(1)
    assert rope.units == 40_000 and rope.chars == len(text) and str(rope) == text and rope.height <= 9
    for _ in range(50):
        a, b = R.split_units(rope, r.randint(0, 40_000))
        assert str(a) + str(b) == text and a.units + b.units == 40_000 and a.chars + b.chars == len(text)
        assert height_bound(a) and height_bound(b) and height_bound(R.joined(b, a)) and str(R.joined(b, a)) == str(b) + str(a)
        at = r.randint(0, len(text))
        c, d = R.split_chars(R.rope_of_chars(text), at)
        assert str(c) == text[:at] and str(d) == text[at:]


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "b", "c"), ("ab", "bc", "x"), ("a", "ab", "c"), ("aa", "bb", "cc")])
def test_sentinels_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        R.FimOptions(prefix=marks[0], suffix=marks[1], middle=marks[2])
