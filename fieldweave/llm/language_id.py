"""Language identification by nearest centroid.

A text is a TF-IDF vector of its byte n-grams, hashed to a fixed number of dimensions and normalised. Each
language has several centroids, from spherical k-means over a bounded sample of its labelled rows. A text
gets the language of the centroid of the greatest cosine; it is rejected if it lies farther away than
nearly all of that language's sample, by a margin that is wider for short texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text_kernel import steps, text_bytes, text_slices

#: What n-grams see: lower-case ASCII letters, a space for all other ASCII, and the bytes of other characters.
SEEN = np.full(256, 32, np.uint8)
SEEN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
SEEN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
SEEN[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageOptions:
    """per_language bounds the sample that the model is fitted on: about so many rows of each language, chosen by a hash of doc_id and text."""

    dims: int = 4096
    sizes: tuple[int, ...] = (1, 2, 3)
    per_language: int = 1000
    centroids: int = 4
    rounds: int = 10
    far_quantile: float = 0.01
    margin: float = 0.6
    short_bytes: int = 200  # texts of fewer have few n-grams, so they lie farther from all languages
    short_margin: float = 0.3


@dataclass(frozen=True)
class LanguageModel:
    """centroids[i] belongs to languages[owner[i]]; a text of language l is rejected under a cosine of least[l], times the margin."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray
    options: LanguageOptions


def counts(column: pa.Array, options: LanguageOptions) -> np.ndarray:
    """How often each n-gram dimension occurs in each text."""
    data, offsets = text_bytes(column)
    n, dims = len(column), options.dims
    out = np.zeros((n, dims), np.float32)
    if not len(data):
        return out
    seen = SEEN[data].astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    for size, factor in zip(options.sizes, steps(3, len(options.sizes)) | np.uint64(1)):
        if len(seen) < size:
            continue
        code = seen[: len(seen) - size + 1]
        for i in range(1, size):
            code = (code << np.uint64(8)) | seen[i : len(seen) - size + 1 + i]
        dim = ((code * factor) >> np.uint64(40)).astype(np.int64) % dims
        same = row[: len(code)] == row[size - 1 :]
        out += np.bincount((row[: len(code)] * dims + dim)[same], minlength=n * dims).reshape(n, dims)
    return out


def vectors(column: pa.Array, idf: np.ndarray, options: LanguageOptions) -> np.ndarray:
    x = counts(column, options) * idf
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batch, most=1 << 20):
        for first in range(0, part.num_rows, 256):
            yield part.slice(first, 256)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids; begins with the row nearest to the mean, then rows far from those chosen."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    for _ in range(1, min(k, len(x))):
        near = (x @ x[chosen].T).max(axis=1)
        # Far, but not the farthest few: those are often broken texts.
        order = np.argsort(near, kind="stable")
        chosen.append(int(order[len(order) // 20]))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def held_out(doc_id=None):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    key = F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def fit(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """A model of the labelled rows that are not held out."""
    spark = docs.sparkSession
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # One row for each language there is.
    sizes = learn.groupBy("lang").count().collect()
    if not sizes:
        return LanguageModel((), np.zeros(0, int), np.zeros((0, options.dims), np.float32), np.zeros(0), np.ones(options.dims, np.float32), options)
    rate = spark.createDataFrame([(lang, int(10**9 * min(1.0, options.per_language / n))) for lang, n in sizes], "lang string, _rate long")
    drawn = learn.select("doc_id", "text", "lang").join(F.broadcast(rate), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(10**9)) < F.col("_rate"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows = pa.array([x.tobytes() for x in counts(part.column("text"), options)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("doc_id"), rows], ["lang", "doc_id", "counts"])

    sample = shared.written(shared.arrow_map(drawn, counted, "lang string, doc_id long, counts binary"), "language_sample")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(options.dims)
        for batch in batches:
            for row in batch.column("counts").to_pylist():
                df += np.frombuffer(row, np.float32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    found = shared.arrow_map(sample.coalesce(8), seen, "n long, df binary").collect()
    idf = np.log((1 + sum(x.n for x in found)) / (1 + sum(np.frombuffer(x.df) for x in found)))
    idf = (np.maximum(idf, 0) + 0.1).astype(np.float32)

    def centroids(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id"]).head(2 * options.per_language)
        x = np.stack([np.frombuffer(b, np.float32) for b in rows["counts"]]) * idf
        x = (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)
        c = spherical_kmeans(x, options.centroids, options.rounds)
        near = (x @ c.T).max(axis=1)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "least": [float(np.quantile(near, options.far_quantile))], "k": [len(c)], "centroids": [c.astype(np.float32).tobytes()]})

    made = sorted(sample.groupBy("lang").applyInPandas(centroids, "lang string, least double, k int, centroids binary").collect())
    return LanguageModel(
        tuple(x.lang for x in made), np.concatenate([np.full(x.k, i) for i, x in enumerate(made)]).astype(int), np.concatenate([np.frombuffer(x.centroids, np.float32).reshape(x.k, -1) for x in made]), np.array([x.least for x in made]), idf, options
    )


MADE = "held_out boolean, lang_pred string, score double, rejected boolean"


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with held_out, lang_pred, score (the cosine) and rejected.

    Null texts and those without a letter are `und` with score 0, and rejected. Others have the nearest
    language even where they are rejected; of equally near ones, the first in the order of their names.
    Without any labelled row to learn from all are `und`. Rows are predicted one by one from the text
    alone. Columns of docs with the name of one that is made are replaced.
    """
    made = [x.split()[0] for x in MADE.split(", ")]
    shared.small_batches(docs.sparkSession)
    source = docs.drop(*made).withColumn("held_out", held_out())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", " + ", ".join(MADE.split(", ")[1:])
    languages = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                n = part.num_rows
                letter = np.array([bool(x and _LETTER.search(x)) for x in part.column("text").to_pylist()])
                best, score = np.full(n, len(model.languages)), np.zeros(n)
                if model.languages:
                    cosine = vectors(part.column("text"), model.idf, model.options) @ model.centroids.T
                    near = np.argmax(cosine, axis=1)
                    best = np.where(letter, model.owner[near], best)
                    score = np.where(letter, np.clip(cosine[np.arange(n), near].astype(float), 0, 1), 0.0)
                short = np.diff(text_bytes(part.column("text"))[1]) < model.options.short_bytes
                margin = np.where(short, model.options.short_margin, model.options.margin)
                rejected = ~letter | (score < np.append(model.least, np.inf)[best] * margin)
                columns = [pa.array(languages[best], pa.string()), pa.array(score), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *made[1:]])

    return shared.arrow_map(source, run, schema)


def identified(docs: DataFrame, options: LanguageOptions = LanguageOptions()) -> DataFrame:
    """The documents that are not rejected, with the columns of docs.

    Null texts and those without a letter are rejected; repeated rows fare alike. Without labelled rows all
    are rejected. Columns of docs keep their values, whatever their names.
    """
    plain, own = shared.set_aside(docs, [x.split()[0] for x in MADE.split(", ")])
    return own(predict(plain, fit(plain, options)).filter(~F.col("rejected")))
