"""Language-model scores with stupid backoff, as a table of n-gram counts joined to the n-grams of the documents.

Documents are stored in blocks of a few MB of text, as numbers into the block's list of word hashes, so that words are
cut and hashed once. The n-grams of a block, exploded and counted within it, leave it as
arrays, one for each range of their hashes, and are dealt out by range: what comes together is one partition of
the count table. There the arrays are rows (block, gram, n) again; one sort by gram gives each gram's count over
the corpus and joins it to the rows, of which those go back to their blocks that occur more than once. A block
then sums up its documents' scores.

An n-gram is one row for each block however often it occurs, so that frequent ones make no partition large. The
ranges are taken in a few passes, each of which ends before the next one begins, so that only a part of the rows
is on disk at a time. All that moves grows in proportion to the input.

A word counts as its bytes between ASCII white space. A document's own n-grams are taken out of the
counts before it is scored, so what nothing but the document itself has backs off.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .text_kernel import U, Words, mix, shingles, steps, text_slices, words

BLOCKS = "block long, n_words long, vocabulary binary, payload binary"
GRAMS = "range int, block long, grams array<long>, n array<int>"
COUNTS = "block long, range int, steps array<int>, total array<long>"
SCORES = "doc_id long, n_words long, n_full long, score double"


def exploded(found: Words, hashes: np.ndarray, order: int, orders: Sequence[int] | None = None) -> np.ndarray:
    """For n of 1 to order, the hash of the n-gram that ends at each word (0 where none does, and for n not in orders).

    The longest n-grams have the upper three quarters of the hashes, all others the lowest, so that a pass over a part makes only what it needs.
    """
    grams = np.zeros((order, len(hashes)), U)
    for n in orders or range(1, order + 1):
        value, at = shingles(found, n, hashes)
        value = mix(value + steps(10, order)[n - 1])
        part = U(1) + value % U(3) if n == order else U(0)
        grams[n - 1, at + n - 1] = np.maximum((part << U(62)) | (value >> U(2)), U(1))
    return grams


def range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Equal ranges of the hashes, in order."""
    return (((grams >> U(32)) * U(ranges)) >> U(32)).astype(np.int32)


def _to_blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        ids, hashes, lengths, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal block
            word, first, code = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            order = np.argsort(first)
            number = np.empty(len(word), np.uint32)
            number[order] = np.arange(1, len(word) + 1, dtype=np.uint32)
            number = number[code]
            number[first] = 0  # a word that is new has the next number
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            docs = pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(number))], ["doc_id", "words"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_batch(docs)
            block += 1
            columns = [pa.array([block]), pa.array([int(ends[-1])]), *(pa.array([x], pa.binary()) for x in (word[order].tobytes(), sink.getvalue().to_pybytes()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "n_words", "vocabulary", "payload"])

        for batch in batches:
            for part in text_slices(batch, most=block_bytes // 4):
                w = words(part.column("text"))
                ids.append(part.column("doc_id"))
                hashes.append(w.hashes())
                lengths.append(np.diff(w.bounds))
                size += part.nbytes
                if size >= block_bytes:
                    yield out()
                    ids, hashes, lengths, size = [], [], [], 0
        if ids:
            yield out()

    return run


def block_words(vocabulary: bytes, payload: bytes) -> tuple[pa.Array, Words, np.ndarray]:
    """The ids of a block's documents, where their words are, and the hashes of these."""
    with pa.ipc.open_stream(payload) as file:
        docs = file.read_all().combine_chunks().to_batches()[0]
    lists = docs.column("words")
    bounds, number = lists.offsets.to_numpy(), lists.values.to_numpy()
    new = number == 0
    hashes = np.frombuffer(vocabulary, U)[np.where(new, np.cumsum(new), number).astype(np.int64) - 1]
    none = np.empty(0, np.int64)
    return docs.column("doc_id"), Words(none, bounds, none, none, np.repeat(np.arange(len(lists)), np.diff(bounds)), bounds), hashes


def _grams_of_blocks(order: int, ranges: int, low: int, high: int):
    """The n-grams of each block in the ranges from low to high, sorted, and how often each occurs."""
    least, most = U(range_start(low, ranges)), U(range_start(high, ranges) - 1)
    orders = [n for n in range(1, order + 1) if (most >= U(1 << 62) if n == order else least < U(1 << 62))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "vocabulary", "payload"))):
                _, w, hashes = block_words(vocabulary, payload)
                grams = exploded(w, hashes, order, orders)
                gram, n = np.unique(grams[(grams > 0) & (grams >= least) & (grams <= most)], return_counts=True)
                own = range_of(gram, ranges)
                cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
                ends = pa.array(np.append(cut, len(gram)).astype(np.int32))
                columns = [pa.array(own[cut]), pa.array(np.full(len(cut), block)), pa.ListArray.from_arrays(ends, pa.array(gram.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["range", "block", "grams", "n"])

    return run


def range_start(i: int, ranges: int) -> int:
    """The least hash of range i; of the range after the last one, one above the greatest hash."""
    return -(-(i << 32) // ranges) << 32


def _by_block(most: int = 1 << 18):
    """Rows (range, block, place, total) as arrays for each range and block, some hundred thousand rows at a time; places as steps from the one before."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        range_, block, place, total = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("range", "block", "place", "total"))
        sort = np.argsort(block, kind="stable")  # rows come by gram, so those of a block and range are in order of place
        range_, block, place, total = range_[sort], block[sort], place[sort], total[sort]
        cut = np.flatnonzero(np.append(True, (range_[1:] != range_[:-1]) | (block[1:] != block[:-1])))
        step = np.diff(place, prepend=place[:1])
        step[cut] = place[cut]
        ends = pa.array(np.append(cut, len(block)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(range_[cut]), pa.ListArray.from_arrays(ends, pa.array(step)), pa.ListArray.from_arrays(ends, pa.array(total))], ["block", "range", "steps", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def counted(blocks: DataFrame, order: int, ranges: int, low: int, high: int, parts: int) -> DataFrame:
    """COUNTS rows: where in the sorted n-grams of a block and range those stand that occur more than once, and their counts over all blocks."""
    grams = shared.arrow_map(blocks.select("block", "vocabulary", "payload"), _grams_of_blocks(order, ranges, low, high), GRAMS)
    rows = grams.repartition(parts, "range").select("range", "block", F.posexplode(F.arrays_zip("grams", "n")).alias("place", "x"))
    rows = rows.select("range", "block", "place", F.col("x.grams").alias("gram"), F.col("x.n").alias("n"))
    # Rows of one gram are in one range, so they are together already; each gets the sum over all.
    window = Window.partitionBy("gram", "range")
    seen = rows.withColumn("total", F.sum("n").over(window)).filter("total > 1")
    return shared.arrow_map(seen.select("range", "block", "place", "total"), _by_block(), COUNTS)


def _score(order: int, backoff: float, all_words: int, ranges: int):
    def scored(docs: tuple[pa.Array, Words, np.ndarray], counts: list[tuple]) -> pa.RecordBatch:
        doc_ids, w, hashes = docs
        grams = exploded(w, hashes, order)
        present = grams > 0
        gram, at = np.unique(grams[present], return_inverse=True)
        begin = np.searchsorted(range_of(gram, ranges), np.arange(ranges))
        totals = np.zeros(len(gram), np.int64)
        for range_, step, total in counts:
            totals[begin[range_] + np.cumsum(step)] = total
        counted = totals[at] > 0  # all others occur once in the corpus, here
        doc, at = np.broadcast_to(w.doc, grams.shape)[present][counted], at[counted]
        _, own, n = np.unique(doc * (len(totals) + 1) + at, return_inverse=True, return_counts=True)
        found = np.zeros(len(counted))
        found[counted] = totals[at] - n[own]  # without the document's own
        rest = np.zeros(grams.shape)
        rest[present] = found
        n_words = np.diff(w.bounds)
        others = np.maximum(all_words - n_words, 1)[w.doc]
        value = np.maximum(rest[0], 1) / others
        used = np.ones(len(value), np.int64)
        for n in range(2, order + 1):
            long = present[n - 1]
            seen = long & (rest[n - 1] > 0)
            i = np.flatnonzero(seen)
            value[long & ~seen] *= backoff
            value[i] = rest[n - 1][i] / rest[n - 2][i - 1]
            used[i] = n
        total = np.bincount(w.doc, weights=np.log10(value), minlength=w.n_docs)
        full = np.bincount(w.doc, weights=used == order, minlength=w.n_docs).astype(np.int64)
        mean = np.round(total / np.maximum(n_words, 1), 4)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_words), pa.array(full), pa.array(mean, mask=n_words == 0)], ["doc_id", "n_words", "n_full", "score"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            block, range_, vocabulary, payload = (batch.column(c).to_pylist() for c in ("block", "range", "vocabulary", "payload"))
            step, total = batch.column("steps"), batch.column("total")
            for i in range(batch.num_rows):
                yield block[i], range_[i], (vocabulary[i], payload[i]), step[i], total[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of_block in groupby(rows(batches), key=lambda x: x[0]):
            found, docs = [], None
            for _, range_, payload, step, total in of_block:
                if range_ < 0:
                    docs = block_words(*payload)
                else:
                    found.append((range_, step.values.to_numpy(), total.values.to_numpy()))
            yield scored(docs, found)

    return run


def backoff_scores(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, block_bytes: int = 5 << 19, passes: int = 4) -> DataFrame:
    """doc_id, n_words, n_full (words scored by their longest n-gram) and score of each row of docs.

    score is the mean decimal logarithm of S(word | words before it), rounded to 4 places: the share of the
    n-gram among the occurrences of its context in all other rows, or `backoff` times that with a shorter
    context; a word that no other row has counts as if one had it. The first words of a text have the
    context there is. Null and empty texts have no words and a null score. Repeated rows are rows: each is
    scored against the others, its copies among them. Only doc_id and text are used.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = shared.written(shared.arrow_map(texts, _to_blocks(block_bytes), BLOCKS), "lm_blocks")
    all_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * parts
    bounds = [ranges * i // passes for i in range(passes + 1)]
    counts = [shared.written(counted(blocks, order, ranges, a, b, parts), "lm_counts") for a, b in zip(bounds, bounds[1:])]
    both = blocks.select("block", F.lit(-1).alias("range"), "vocabulary", "payload")
    for part in counts:
        both = both.unionByName(part, allowMissingColumns=True)
    joined = both.repartition(parts, "block").sortWithinPartitions("block", "range")
    return shared.arrow_map(joined, _score(order, backoff, all_words, ranges), SCORES)
