"""Each operator against a plain version of what it does."""

import base64
import collections
import hashlib
import math
import random
import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import backoff_lm, byte_bpe, dart_minhash, exact_dedup, language_id, license_scan, line_quality, packing, ring_shard, token_store
from fieldweave.llm.queries import op9_backoff_lm
from fieldweave.llm.shared import new_dir

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split()


def prose(r, n, words=WORDS):
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    texts = [prose(r, r.randint(0, 120)) for _ in range(60)]
    texts += [t.replace(" ", "  \n") for t in texts[:10]] + texts[:5]
    for t in texts[10:25]:
        w = t.split()
        if len(w) > 40:
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return dict(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("budget", [300, 48 << 20])
def test_exact_groups_with_and_without_spills(docs, corpus, budget):
    same = collections.defaultdict(list)
    for i, t in corpus.items():
        same["".join(t.split())].append(i)
    rows = exact_dedup.exact_groups(docs, budget=budget).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        key = "".join(corpus[r.doc_id].split())
        keep = min(same[key], key=lambda i: (-len(corpus[i]), i))
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(same[key]), keep == r.doc_id, hashlib.sha256(key.encode()).hexdigest())


def test_grace_partitions_again_until_it_fits():
    records = [(hashlib.sha256(b"%d" % (i % 200)).digest(), b"%d" % (i % 200) * 50, 1, 1, i) for i in range(1000)]
    got = list(exact_dedup.grace(records, 2000))
    assert sorted((x[1], x[2], x[4]) for x in got) == sorted((b"%d" % i * 50, 5, i) for i in range(200))
    with pytest.raises(ValueError):
        list(exact_dedup.grace([(b"h" * 32, b"a", 1, 1, 1), (b"h" * 32, b"b", 1, 1, 2)], 10**6))


def test_line_rules(spark):
    clean = "A line of plain words that ends as a sentence does, with a stop.\n" * 1 + "Another one follows here, and it too is made of words."
    rows = [
        (0, clean), (1, clean + "\nHome | About | News | Contact | Help"), (2, "Shout!! this!! is!! all!! loud!! and!! very!! long!! indeed!! friend!!"), (3, "one two\n" * 30), (4, "a b c"),
        (5, clean + "\nWe use cookies to make this better."), (6, "Home | About | News | Contact | Help | More | Less | Other\nA few words."),
    ]
    got = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(7)] == [True, True, False, False, False, True, False]
    assert got[1].clean_text == clean + "\n" and got[5].clean_text == clean + "\n" and got[0].clean_text == clean
    assert got[3].n_dup_lines == 29 and got[3].n_repeat_words == 60 and got[4].base_failed


def test_short_lines_must_end_like_sentences(spark):
    long = "word " * 30 + "and so on"  # may be cut off
    lines = {"A heading": True, "It ends.": False, "Really?": False, 'He said "yes."': False, "So it goes\u2026": False, "\u00abOui\u00bb": False, "not here,": True, long: False, "   ": False, "Wir verwenden Cookies.": True}
    text = "\n".join(lines)
    row = line_quality.line_quality(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
    assert row.clean_text.split("\n") == [x for x, fails in lines.items() if not fails] + [""] and row.n_lost_lines == sum(lines.values())


def test_the_dictionary_is_trained_on_whole_documents(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} " * (3000 if i == 3 else 5) + "tail " * 40) for i in range(60)], "doc_id long, text string").repartition(3)
    options = token_store.StoreOptions(dict_bytes=2048)
    made = token_store.shared_dictionary(docs, P.path("word_bpe_49k.json"), options)
    assert 200 < len(made) <= 2048 and made[:4] == bytes.fromhex("37a430ec")  # a trained one begins so
    assert made == token_store.shared_dictionary(docs.repartition(5), P.path("word_bpe_49k.json"), options)
    assert token_store.shared_dictionary(docs.limit(0), P.path("word_bpe_49k.json"), options) == b""
    assert token_store.train([b"ab"], options) == b""


def test_token_store_round_trip(spark, docs, corpus):
    from tokenizers import Tokenizer

    path = new_dir(spark, "store")
    token_store.write_tokens(docs, path, P.path("word_bpe_49k.json"), token_store.StoreOptions(block_bytes=500, dict_bytes=1024))
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    rows = token_store.read_tokens(spark, path).orderBy("doc_id").collect()
    for r in rows:
        ids = [*tokenizer.encode(corpus[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4"))
        start += len(ids)
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    block = token_store.Block(bytes(spark.read.parquet(f"{path}/blocks").filter("first_id <= 7 and last_id >= 7").first()["payload"]), dictionary)
    i = block.doc_ids.tolist().index(7)
    assert block.ids(i).tolist() == rows[7].ids
    with pytest.raises(ValueError):
        token_store.Block(block.payload, b"other")


def test_language_of_held_out_texts(spark):
    r = random.Random(2)
    sets = {"en": WORDS, "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas que vous par sur faire plus dire me".split()}
    rows = [(i, prose(r, 60, sets[lang]), lang) for i, lang in enumerate(list(sets) * 80)] + [(1000, "12345 !!!", "en"), (1001, None, "fr"), (1002, "zzz qqq xxyy " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in language_id.predict(df, language_id.fit(df)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(240)) and len(held) > 20
    assert all(got[i].lang_pred == rows[i][2] and not got[i].rejected for i in held)
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0.0 and got[1002].rejected


def test_prediction_ignores_other_columns(spark, docs):
    df = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = language_id.fit(df)
    a = language_id.predict(df, model).select("doc_id", "lang_pred", "score").collect()
    b = language_id.predict(df.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id")), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("window, budget", [(16, 1 << 20), (16, 0), (16, 200), (64, 1 << 20)])
def test_windows_have_each_id_once_and_no_padding(window, budget):
    r, packer = random.Random(1), packing.WindowPacker(window, budget)
    texts = [np.arange(i * 1000, i * 1000 + r.randint(1, 3 * window)) for i in range(200)]
    closed = [w for i, ids in enumerate(texts) for w in packer.add(i, ids)]
    closed += packer.finish()
    got = collections.defaultdict(list)
    for pieces in closed:
        n = sum(len(x[2]) for x in pieces)
        assert n == window or n & (n - 1) == 0
        for doc, start, ids in pieces:
            got[doc].append((start, ids))
    for i, ids in enumerate(texts):
        assert np.concatenate([x[1] for x in sorted(got[i], key=lambda x: x[0])]).tolist() == ids.tolist()
    assert sum(sum(len(x[2]) for x in p) < window for p in closed) <= window.bit_length()


def test_windows_are_the_same_with_and_without_a_file():
    def run(budget):
        packer, r = packing.WindowPacker(64, budget), random.Random(3)
        closed = [w for i in range(3000) for w in packer.add(i, np.arange(r.choice([40, 40, 40, 70, 9])))]  # mostly more than half a window
        n_open = int(packer.count.sum())
        return n_open, [[(d, s, x.tolist()) for d, s, x in w] for w in [*closed, *packer.finish()]]

    assert run(1 << 30) == run(0) == run(5000) and run(0)[0] > 1000


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    packer = packing.WindowPacker(8)
    closed = [w for i, n in enumerate([5, 5, 5, 3]) for w in packer.add(i, np.arange(n))]
    assert packer.count[5] == 2 and [sum(len(x[2]) for x in w) for w in closed] == [8]


def brute_classes(texts, similarity=0.8):
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = frozenset(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if label[a] < label[b] and sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return label


def test_near_classes_equal_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    base = [prose(r, 120, words) for _ in range(12)]
    texts = list(base)
    for t in base:
        for _ in range(3):
            w = t.split()
            for _ in range(r.choice([1, 2, 4, 6])):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    chain = base[0].split()
    for i in range(30):  # a bucket that no single leader covers
        chain = [*chain[2:], r.choice(words), r.choice(words)]
        texts.append(" ".join(chain))
    texts += ["", "a b", "a b", "a  b\n", "c d e f g"]
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in dart_minhash.near_classes(df, dart_minhash.NearOptions(strays=3, members=5)).collect()}
    want = brute_classes(texts)
    assert {i: got[i].class_id for i in texts} == want
    size = collections.Counter(want.values())
    assert all(got[i].class_size == size[want[i]] and got[i].kept == (want[i] == i) for i in texts)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_agree_as_often_as_sets_are_similar(weighted):
    r = np.random.default_rng(4)
    el = np.unique(r.integers(0, 2**60, 400)).astype(np.uint64)
    a = r.integers(1, 6, len(el)).astype(float) if weighted else np.ones(len(el))
    b = np.maximum(1, a + r.integers(-2, 3, len(el))) if weighted else np.ones(len(el))
    keep = np.ones(len(el), bool) if weighted else np.arange(len(el)) < 280
    s = dart_minhash.signatures(np.concatenate([np.zeros(len(el), int), np.ones(keep.sum(), int)]), np.concatenate([el, el[keep]]), np.concatenate([a, b[keep]]), 2, 1024)
    b = b * keep
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.06


def sequential_ring(keys, shards, virtual):
    """The rule by the definition: own arcs first, then leftovers clockwise, point by point."""
    points = ring_shard.ring_points(shards, virtual)
    places = [p for p, _ in points]
    arcs = collections.defaultdict(list)
    for k in keys:
        arcs[bisect_left(places, ring_shard.place(str(k))) % len(points)].append(k)
    for arc in arcs:
        arcs[arc].sort(key=lambda k: ((ring_shard.place(str(k)) - places[arc - 1] - 1) % ring_shard.RING, k))
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out, moving = {}, []
    for arc, (_, s) in enumerate(points):
        own = arcs[arc]
        for k in own[: room[s]]:
            out[k] = s
        arcs[arc], room[s] = own[room[s] :], room[s] - min(room[s], len(own))
    for lap in range(2):
        for arc, (_, s) in enumerate(points):
            while moving and room[s]:
                out[moving[-1].pop(0)] = s
                room[s] -= 1
                if not moving[-1]:
                    moving.pop()
            if not lap and arcs[arc]:
                moving.append(arcs[arc])
    return out


def test_ring_equals_the_sequential_rule(spark):
    keys = list(range(0, 3000, 3))
    df = spark.createDataFrame([(k, "é" * (k % 7)) for k in keys], "doc_id long, text string").repartition(5)
    rows = ring_shard.ring_shards(df, 7, virtual=16).collect()
    assert {r.doc_id: r.shard for r in rows} == sequential_ring(keys, 7, 16)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        text = ("é" * (r.doc_id % 7)).encode()
        assert r["size"] == len(text) + 8 and r.text_crc32 == zlib.crc32(text)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_few_documents_move_when_a_shard_comes(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    a, b = ({r.doc_id: r.shard for r in ring_shard.ring_shards(df, n).collect()} for n in (20, 21))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.25


def test_bpe_equals_the_library(spark, corpus):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", " ", "a   b", "a \n\n b  ", "it's 'll", "日本 語", "<|endoftext|>", "zq" * 700, "x" * 20_000, "  tail  ", "\x1c a\x85b   c"]
    texts = dict(enumerate([*corpus.values(), *odd]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    encoded = byte_bpe.bpe_encode(df, path, P.PATTERN)
    for r in byte_bpe.bpe_decode(encoded, path).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded).decode() == texts[r.doc_id]
    for r in byte_bpe.round_trip(df, path, P.PATTERN).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


@pytest.mark.parametrize("order", [1, 3])
def test_backoff_scores_equal_the_definition(docs, corpus, order):
    words = {d: t.split() for d, t in corpus.items()}
    own = {d: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for d, w in words.items()}
    total, n = sum(own.values(), collections.Counter()), sum(map(len, words.values()))

    def s(d, context, w):
        c = lambda g: total[g] - own[d][g]
        if not context:
            return max(c((w,)), 1) / max(n - len(words[d]), 1)
        return c((*context, w)) / c(context) if c((*context, w)) > 0 else 0.4 * s(d, context[1:], w)

    for r in backoff_lm.backoff_scores(docs, order=order, block_bytes=2000).collect():
        w = words[r.doc_id]
        assert r.n_words == len(w)
        if w:
            assert r.score == pytest.approx(sum(math.log10(s(r.doc_id, tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(len(w))) / len(w), abs=1e-4)
        else:
            assert r.score is None


def test_ranges_cut_all_hashes_in_order():
    x = np.sort(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    for ranges in (1, 7, 96):
        own = backoff_lm.range_of(x, ranges)
        starts = [backoff_lm.range_start(i, ranges) for i in range(ranges + 1)]
        assert starts[0] == 0 and starts[-1] == 2**64 and (np.diff(own) >= 0).all()
        assert all(starts[i] <= v < starts[i + 1] for i, v in zip(own.tolist(), x.tolist()))


@pytest.mark.parametrize("text, labels, score", [
    ("Released under the MIT License.", "mit-notice", 1.0), ("released, under the terms of the MIT license", "mit-notice", 1.0), ("under some MIT license", "", 0.0), ("CC BY-NC 4.0 it is", "cc-by", 0.5), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 1.0),
    ("Copyright (c) 2001-2004 Jane Q. Doe. All rights reserved.", "copyright-notice,reserved", 1.0), ("Copyright by nobody at all, ever, anywhere, in no place that anyone knows: all rights reserved", "reserved", 0.5), ("under the GNU General Public License, version 3", "gpl,gpl-3.0-notice", 1.0),
    ("General public license", "gpl", 0.5), ("", "", 0.0),
])
def test_templates(text, labels, score):
    x = license_scan.Scanner().scan(pa.array([text]))
    got = {s["label"] for s in x["spans"][0]}
    assert ",".join(sorted(got | x["base"][0])) == labels and (1.0 if got else 0.5 if x["base"][0] else 0.0) == score


def test_whole_licenses_are_held_to_their_mandatory_wording():
    fill = {"name": "software", "holder": "the authors or copyright holders", "possessive": "its"}
    labels = lambda text: {s["label"] for s in license_scan.Scanner().scan(pa.array([text]))["spans"][0]}
    for label, markup in license_scan.TEMPLATES[:10]:
        words = [x if isinstance(x, str) else " ".join(x[1]) if x[0] == "optional" else "the authors" if x[1] <= 2 <= x[2] else "x" for x in license_scan.parsed(markup)]
        text = "Copyright (c) 2001 Someone\n\n" + " ".join(words)
        assert label in labels(text.capitalize()), (label, fill)
        mandatory = [i for i, x in enumerate(license_scan.parsed(markup)) if isinstance(x, str)]
        for i in (mandatory[3], mandatory[len(mandatory) // 2], mandatory[-1]):  # one word changed, or the end broken off
            assert label not in labels(" ".join([*words[:i], "changed", *words[i + 1 :]])) and label not in labels(" ".join(words[:i]))


def test_automata_accept_what_their_patterns_match():
    import re

    r = random.Random(3)
    for _, markup in license_scan.TEMPLATES:
        automaton, pattern = license_scan.Automaton(markup), re.compile(license_scan.as_regex(markup))
        for _ in range(15):
            words = []
            for part in license_scan.parsed(markup):
                if isinstance(part, str):
                    words += [part] * (r.random() > 0.02)
                elif part[0] == "optional":
                    words += part[1] * (r.random() < 0.5)
                else:
                    words += ["free"] * r.randint(max(part[1] - 1, 0), part[2] + 1)
            assert (automaton.match(words, 0) >= 0) == bool(re.match(pattern, " " + " ".join(words) + " "))


def test_op9_scores_by_trigrams(spark, tmp_path):
    pd.DataFrame({"doc_id": [1, 2, 3], "text": ["a b c d", "a b c e", "x b c"]}).to_parquet(tmp_path / "documents.parquet")
    found = {r.doc_id: (r.n_words, r.n_full) for r in op9_backoff_lm(spark, str(tmp_path)).collect()}
    assert found == {1: (4, 1), 2: (4, 1), 3: (3, 0)}
