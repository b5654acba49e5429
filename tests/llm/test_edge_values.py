"""What null, empty, long, tied and repeated rows come to, and that a caller's columns keep their values whatever their names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldweave.llm import backoff_lm, byte_bpe, dart_minhash, exact_dedup, language_id, license_scan, line_quality, packing, ring_shard, token_store
from fieldweave.llm.shared import new_dir

from .test_edges import CLASH, LONG, ROWS, SCHEMA

SENTENCE = ROWS[0][1]


@pytest.fixture(scope="module")
def docs(spark):
    # Each clashing column has a value of its own for each row.
    numbered = spark.createDataFrame([(*r, n) for n, r in enumerate(ROWS)], f"{SCHEMA}, row int")
    return numbered.withColumns({c: F.col("row") * 100 + i for i, c in enumerate(CLASH)}).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_exact_groups(docs):
    got = by_id(exact_dedup.exact_groups(docs).collect())
    same = "".join(SENTENCE.split())
    assert [(r.keep_id, r.group_size, r.text_sha256) for i in (1, 2) for r in got[i]] == [(1, 3, sha(same))] * 3 and not got[2][0].kept
    # Null, empty and white texts are one group; the longest original stays.
    assert [(r.keep_id, r.group_size, r.kept) for i in (3, 4, 6) for r in got[i]] == [(6, 4, False), (6, 4, False), (6, 4, True)]
    assert (got[5][0].group_size, got[5][0].text_sha256) == (1, sha("".join(LONG.split())))


def test_line_quality(docs):
    got = by_id(line_quality.line_quality(docs).collect())
    for i in (3, 4, 6):
        assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got[i]] == [(0, 0, 0, 0, 0, True, False)]
    assert (got[5][0].n_words, got[5][0].n_repeat_words, got[5][0].kept) == (100_000, 100_000, False) and got[7][0].n_words == 1
    assert [(r.n_words, r.kept) for r in got[1]] == [(13, True)] * 2


def test_token_store(docs):
    path = new_dir(docs.sparkSession, "t")
    token_store.write_tokens(docs, path, P.path("word_bpe_49k.json"))
    rows = sorted(token_store.read_tokens(docs.sparkSession, path).collect(), key=lambda r: r.start)
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    got = by_id(rows)
    assert all((r.n_tokens, r.ids_crc32, r.ids) == (1, end, [2]) for i in (3, 4, 6) for r in got[i])
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7, 8] and got[1][0].ids == got[1][1].ids == got[2][0].ids
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_language(docs):
    got = by_id(language_id.predict(docs, language_id.fit(docs)).collect())
    assert all((r.lang_pred, r.score, r.rejected) == ("und", 0.0, True) for i in (3, 4, 6) for r in got[i])
    assert got[1][0].lang_pred in ("en", "fr", "de") and got[1][0].score == got[1][1].score


def test_packing(docs):
    rows = packing.packed(docs, P.path("byte_bpe_50k.json")).collect()
    got = by_id(rows)
    assert all([(r.start, r.length, r.doc_tokens, r.ids) for r in got[i]] == [(0, 1, 1, [1])] for i in (3, 4)) and sum(r.length for r in got[1]) == 2 * got[1][0].doc_tokens
    assert sum(r.length for r in got[5]) == got[5][0].doc_tokens > 100_000


def test_byte_bpe(docs):
    got = by_id(byte_bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, sha(""), sha("")) for i in (3, 4) for r in got[i])
    texts = {r[0]: r[1] for r in ROWS if r[1] and r[0]}
    assert all(r.decoded_sha256 == sha(t) for i, t in texts.items() for r in got[i])


def test_near_classes(docs):
    got = by_id(dart_minhash.near_classes(docs).collect())
    assert [(r.class_id, r.class_size, r.kept) for i in (1, 2) for r in got[i]] == [(1, 3, True), (1, 3, True), (1, 3, False)]
    assert all((r.class_id, r.class_size, r.kept) == (i, 1, True) for i in (3, 4, 6) for r in got[i]) and all(r.class_id is None and r.kept for r in got[None])


def test_shards(docs):
    rows = ring_shard.ring_shards(docs, 3, virtual=8).collect()
    sizes = [len([r for r in rows if r.shard == s]) for s in range(3)]
    assert sorted(sizes) == [3, 4, 4] and all(sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s])) for s in range(3))
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS}
    for r in rows:  # columns that shards don't make keep their values
        assert all(r[c] == r.row * 100 + i for i, c in enumerate(CLASH) if c not in ("shard", "slot", "size"))


def test_scores(docs):
    got = by_id(backoff_lm.backoff_scores(docs).collect())
    assert all((r.n_words, r.n_full, r.score) == (0, 0, None) for i in (3, 4, 6) for r in got[i])
    assert got[1][0].score == got[1][1].score == got[2][0].score and got[1][0].n_full == 11 and got[7][0].n_words == 1


def test_licenses(docs):
    got = by_id(license_scan.license_scan(docs).collect())
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, 0, None, None, "", "", 0.0) for i in (3, 4, 6) for r in got[i])
    assert got[5][0].n_words == 100_000


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "packing"], ids=lambda s: s[0])
def test_stages_keep_a_callers_columns(docs, stage):
    out = stage[1](docs.sparkSession, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and rows
    for r in rows:
        original = ROWS[r.row]
        n_chars = len(r.text) if stage[0] == "quality rules" else original[4]  # of the text as it is now
        assert (r.doc_id, r.lang, r.source, r.n_chars) == (original[0], *original[2:4], n_chars) and all(r[c] == r.row * 100 + i for i, c in enumerate(CLASH))
        assert r.text == original[1] or stage[0] == "quality rules"
    kept = sorted(r.row for r in rows)
    assert len(set(kept)) == len(kept)
    # Of the repeated row both stay or go together; its copy in other white space goes where copies go.
    assert (0 in kept) == (1 in kept)
    if stage[0] in ("exact dedup", "near dedup"):
        assert 0 in kept and 2 not in kept
