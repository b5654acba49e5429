"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from fieldweave.llm import backoff_lm, byte_bpe, dart_minhash, exact_dedup, language_id, license_scan, line_quality, packing, ring_shard, token_store
from fieldweave.llm.shared import new_dir

LONG = "lorem ipsum dolor sit amet, " * 20_000
ROWS = [
    (1, "Some words that stand here, one after another, in a line of text.", "en", "a", 10),
    (1, "Some words that stand here, one after another, in a line of text.", "en", "a", 10),
    (2, "Some words that stand here,\none after another, in a line of text.", None, None, None),
    (3, "", "en", "a", 0),
    (4, None, "de", None, None),
    (None, "a text without an id", None, None, None),
    (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)),
    (6, "   \n\t ", "fr", "b", 6),
    (7, "x" * 300_000, "en", "b", 1),
    (8, "Ünï ćødé — 日本語   \x00 \x1c <|endoftext|> ''' 🙂", "fr", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["kept", "keep_id", "group_size", "digest", "id", "a", "b", "n", "block", "bucket", "shard", "slot", "size", "labels", "score", "rejected", "held_out", "ids", "label", "class_id", "_drop", "_place", "_digest", "chars", "rep"]


def read_back(docs):
    path = new_dir(docs.sparkSession, "t")
    token_store.write_tokens(docs, path, P.path("word_bpe_49k.json"))
    return token_store.read_tokens(docs.sparkSession, path)


OPERATORS = {
    "exact": exact_dedup.exact_groups,
    "quality": line_quality.line_quality,
    "store": read_back,
    "language": lambda d: language_id.predict(d, language_id.fit(d)),
    "near": dart_minhash.near_classes,
    "shards": lambda d: ring_shard.ring_shards(d, 3, virtual=8),
    "bpe": lambda d: byte_bpe.bpe_decode(byte_bpe.bpe_encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken")),
    "lm": backoff_lm.backoff_scores,
    "license": license_scan.license_scan,
}
STAGES = {name: (lambda f: lambda d: f(d.sparkSession, d, ""))(f) for name, f in corpus_pipeline.STAGES}


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_of_every_kind(docs, name):
    out = OPERATORS[name](docs).select("doc_id").collect()
    assert len(out) == len(ROWS) and sorted(str(r[0]) for r in out) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_rows_of_every_kind(docs, name):
    out = STAGES[name](docs)
    if name != "packing":
        assert out.columns == docs.columns and out.count() <= len(ROWS)
    else:
        assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in ROWS}


@pytest.mark.parametrize("name", [*OPERATORS, *STAGES])
def test_empty_tables(docs, name):
    assert (OPERATORS | STAGES)[name](docs.limit(0)).count() == 0
