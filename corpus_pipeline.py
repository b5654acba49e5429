"""The corpus pipeline: stages from raw documents to packed sequences, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm import dart_minhash, exact_dedup, language_id, line_quality, packing, shared


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes failing lines out of the texts and rejected documents out of the table.

    Null and empty texts are rejected; equal rows fare alike.
    """
    return line_quality.cleaned(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that are far from all languages there are.

    Null texts and those without a letter go; without labelled rows all do.
    """
    return language_id.identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: of those tied in length the least doc_id, with all its rows."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, that of the least doc_id. Texts without a word and rows without an id stay."""
    return dart_minhash.near_deduplicated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in windows of 2048 tokens. A null or empty text is its end id alone."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("packing", packed_sequences),
]

#: SQL can express neither the language model nor the signatures nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the results of the others are written to the shared folder between them, each until the next one is."""
    docs, last = shared.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if last is not None:
            shared.dropped(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
