"""Automata against edit distance by its definition; learning, scoring and contexts on small tables."""

import random
import zlib

import pytest

from fieldweave.llm import toxicity as T

WORDS = ["idiot", "pathetic", "moron", "worthless", "trash", "scum", "disgusting"]


def distance(a, b):
    """Edits with swaps of neighbours, of which no part is edited again."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def changed(r, word, edits):
    for _ in range(edits):
        i, kind = r.randrange(1, len(word)), r.randrange(4)
        c = r.choice("aeistx")
        word = [word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :]][kind]
    return word


def test_automaton_by_definition():
    r, automaton = random.Random(3), T.Automaton(WORDS)
    tried = [changed(r, r.choice(WORDS), r.randint(0, 3)) for _ in range(4000)] + ["", "i", "closer", "pathetics", "idoit", "trsh"]
    hits = 0
    for word in tried:
        # The first character must be right, so the rest is compared.
        near = [(d, w) for w in WORDS if word[:1] == w[0] and (d := distance(word[1:], w[1:])) <= T.edits_allowed(w)]
        assert automaton.nearest(word) == (min(near)[::-1] if near else None), word
        hits += bool(near)
    assert hits > 1000 and automaton.nearest("idoit") == ("idiot", 1) and automaton.nearest("scun") is None


def test_the_automaton_forgets_states_and_goes_on():
    small, large, r = T.Automaton(WORDS, most_states=5), T.Automaton(WORDS), random.Random(5)
    for _ in range(500):
        word = changed(r, r.choice(WORDS), r.randint(0, 2))
        assert small.nearest(word) == large.nearest(word)


def labelled(n=700, seed=8):
    r = random.Random(seed)
    plain = [a + b + c for a in ("ka", "lo", "mi", "tru", "pe") for b in ("ran", "sto", "vel", "dim") for c in ("", "s", "ed", "or", "um")]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [r.choice(plain) for _ in range(r.randint(15, 80))], i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["idiot", "pathetic", "moron", "scum", "zorpl" + r.choice(["ig", "at", "um", "ek", "ol"])])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = labelled()
    return T.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learned_lexicon(model):
    assert {"idiot", "pathetic", "moron", "scum"} <= set(model.lexicon.words)
    assert any("zorpl".startswith(s) or s.startswith("zorp") for s in [*model.lexicon.stems, *model.lexicon.words])
    assert not {w for w in model.lexicon.words if w[:2] in ("ka", "lo")} and model.curve[0] < 0


def test_held_out_rows(spark, model):
    rows, labels = labelled()
    got = {r.doc_id: r for r in T.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(held) > 100 and sum(p == y for p, y in held) >= 0.98 * len(held)


def test_misspelled_words_count(spark, model):
    clean = " ".join(["karans lovel mistoed trudim pevelor"] * 4)
    texts = [clean, f"{clean} idoit {clean} m0ron patthetic", f"{clean} idiooot {clean} m.o.r.o.n", f"{clean} idiot {clean} moron"]
    got = sorted((r.doc_id, r.predicted, [h.term for h in r.hits]) for r in T.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, hits=True).collect())
    assert got == [(0, 0, []), (1, 1, ["idiot", "moron", "pathetic"]), (2, 1, ["idiot", "moron"]), (3, 1, ["idiot", "moron"])]


def test_quotation_weighs_less_than_abuse():
    reader = T.Reader(T.Lexicon({"idiot": 2.0}), T.ToxicityOptions())
    weight = lambda text: [round(w, 3) for _, _, w in reader.hits(text)[1]]
    assert weight("what an idiot there") == [2.0] and weight("so an «idiot» there") == [0.8]
    assert weight('an "old idiot here" there') == [0.8] and weight('the "end" idiot "new"') == [2.0]
    assert weight("she said idiot there") == [1.2] and weight("you idiot") == [2.0] and weight("he called you idiot") == [1.8]
    assert weight("idiot") == [2.0] and weight("") == [] and weight("idiot " * 3) == [2.0] * 3
    assert weight("said " + "so " * 20 + "idiot") == [2.0]


def test_clean_words_are_no_misspellings():
    reader = T.Reader(T.Lexicon({"trash": 3.0}, {"zorp": 2.0}, frozenset(["thrash"])), T.ToxicityOptions())
    terms = lambda text: [(t.term, t.edits) for _, t, _ in reader.hits(text)[1]]
    assert terms("thrash traash zorpig zorp crash") == [("trash", 1), ("zorp*", 0)]


def test_rows_of_every_kind(spark, model):
    rows = [(1, "", 5.0), (2, None, 5.0), (None, "an idiot and a moron, pathetic", 5.0), (3, "idiot moron scum " * 20_000, 5.0), (4, "x" * 300_000, 5.0), (5, " \n ", 5.0), (1, "", 5.0)]
    got = T.scored(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[5].score == by[4].score < 0.1 and by[3].predicted == 1 and by[None].predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "an idiot"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None)], [(1, 1), (2, 0)], [(99, 1)]):
        empty = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert not empty.lexicon.words and {r.predicted for r in T.scored(docs, empty).collect()} == {0}
    assert T.scored(docs.limit(0), empty).count() == 0
