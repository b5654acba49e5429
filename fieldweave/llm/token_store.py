"""Token ids as binary blocks: one zstandard dictionary for all, each document its own frame, an index of offsets.

A block is
    magic, width of an id in bytes, hash of the dictionary, number of documents,
    doc ids, numbers of tokens, offsets of frames,
    frames.
So a short document is read by one slice of its block and one small decompression. Blocks are rows of a
Parquet table written by Spark's own committer to any store that Spark can write; next to the block stand
its range of doc ids, for pruning, and the number of tokens before it in its part of the table. Parts are
ranges of doc ids in ascending order, so only one total for each part is summed up by the driver.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .segments import library_encoder
from .text_kernel import text_slices

MAGIC = b"FWT1"
_HEAD = struct.Struct("<4sB8sI")
_NO_ID = -(2**63)
BLOCKS = "part int, block int, first_id long, last_id long, n_docs int, n_tokens long, part_start long, dict_hash string, payload binary"


@dataclass(frozen=True)
class StoreOptions:
    """sample_docs bounds what the dictionary is trained on: so many documents, each of them whole."""

    end_id: int = 2
    width: int = 2
    level: int = 3
    dict_bytes: int = 64 << 10
    sample_docs: int = 1000
    block_bytes: int = 1 << 20
    chunk: int = 512


def _dtype(width: int) -> str:
    return f"<u{width}"


def pack_block(ids: list[int | None], frames: list[bytes], tokens: list[int], dict_hash: bytes, width: int) -> bytes:
    n = len(ids)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames], dtype=np.int64)]).astype("<u8")
    keys = np.array([_NO_ID if x is None else x for x in ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, width, dict_hash, n), keys.tobytes(), np.array(tokens, "<u8").tobytes(), offsets.tobytes(), *frames])


class Block:
    """Reads a block; with the dictionary, documents one by one."""

    def __init__(self, payload: bytes, dictionary: bytes) -> None:
        magic, self.width, self.dict_hash, n = _HEAD.unpack_from(payload)
        if magic != MAGIC or self.dict_hash != dict_digest(dictionary):
            raise ValueError("not a block of this dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        self.tokens = np.frombuffer(payload, "<u8", n, at + 8 * n)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, at + 16 * n)
        self.payload, self.begin = payload, at + 24 * n + 8
        self.reader = decompressor(dictionary)

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        raw = self.reader.decompress(self.payload[self.begin + a : self.begin + b], max_output_size=int(self.tokens[i]) * self.width)
        return np.frombuffer(raw, _dtype(self.width))


def dict_digest(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_dict(dictionary))


def compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = _dict(dictionary)
    if data:
        data.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_dict_id=False)


def train(samples: list[bytes], options: StoreOptions) -> bytes:
    """A dictionary trained on the samples, the largest that they suffice for; empty if they suffice for none."""
    size = options.dict_bytes
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, level=options.level).as_bytes()
        except (zstandard.ZstdError, ValueError):
            size //= 2
    return b""


def shared_dictionary(docs: DataFrame, tokenizer: str, options: StoreOptions = StoreOptions()) -> bytes:
    """Trained in one task on a bounded sample: the documents of the least hashes of their ids, whole, in chunks of `chunk` ids. Empty if there are none."""
    order = F.xxhash64("doc_id")
    chosen = docs.select("doc_id").orderBy(order, "doc_id").limit(options.sample_docs).select(F.max(order)).first()[0]
    sample = docs.select("doc_id", "text").filter(order <= F.lit(chosen)).limit(options.sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, samples = library_encoder(tokenizer, spaced=False), []
        for batch in batches:
            for part in text_slices(batch):
                ids, ends = encode.batch(part.column("text").to_pylist())
                ids = ids.astype(_dtype(options.width))
                samples += [ids[i : min(b, i + options.chunk)].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist()) for i in range(a, b, options.chunk)]
        yield pa.RecordBatch.from_arrays([pa.array([train(sorted(samples), options)], pa.binary())], ["dictionary"])

    found = shared.arrow_map(sample.coalesce(1), run, "dictionary binary").collect()  # one row
    return bytes(found[0]["dictionary"]) if found else b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, options: StoreOptions = StoreOptions()) -> None:
    """Encodes the texts and writes path/blocks and path/dictionary.

    Null and empty texts have the end id alone. Rows are in ascending order of doc_id, nulls first, and
    those of one doc_id in the order of a hash of their texts, so repeated rows are written as often as they stand
    in docs. Other columns of docs are not used.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    dictionary = shared_dictionary(docs, tokenizer, options)
    digest = dict_digest(dictionary)
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = library_encoder(tokenizer, spaced=False), compressor(dictionary, options.level)
        part_id, block, before = TaskContext.get().partitionId(), 0, 0
        ids_, frames, tokens = [], [], []

        def out() -> pa.RecordBatch:
            nonlocal block, before, ids_, frames, tokens
            total = sum(tokens)
            row = {"part": part_id, "block": block, "first_id": ids_[0], "last_id": ids_[-1], "n_docs": len(ids_), "n_tokens": total, "part_start": before, "dict_hash": digest.hex(), "payload": pack_block(ids_, frames, tokens, digest, options.width)}
            block, before, ids_, frames, tokens = block + 1, before + total, [], [], []
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        size = 0
        for batch in batches:
            for part in text_slices(batch):
                ids, ends = encode.batch(part.column("text").to_pylist())
                if len(ids) and int(ids.max()) >= 1 << (8 * options.width):
                    raise ValueError("an id does not fit the width of the store")
                ids = ids.astype(_dtype(options.width))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
                    frame = writer.compress(np.append(ids[a:b], ids.dtype.type(options.end_id)).tobytes())
                    ids_.append(doc_id)
                    frames.append(frame)
                    tokens.append(b - a + 1)
                    size += len(frame)
                    if size > options.block_bytes:
                        yield out()
                        size = 0
        if ids_:
            yield out()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranges go on into the texts' hashes, so that many rows of one id, or of none, are not one part.
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash")).repartitionByRange(parts, "doc_id", "_hash")
    ordered = ordered.sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")
    shared.arrow_map(ordered, run, BLOCKS).write.parquet(f"{path}/blocks")


SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("part_start", pa.int64()), ("dict_hash", pa.string()), ("payload", pa.binary())])


def read_tokens(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian integers) and, if asked for, ids, of all documents in the files."""
    shared.small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    # One row for each part of the table: as many as the write had partitions.
    totals, base, bases = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect(), 0, []
    for part, n in totals:
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, payload in zip(batch.column("begin").to_pylist(), batch.column("payload").to_pylist()):
                block = Block(payload, dictionary)
                tokens = block.tokens.astype(np.int64)
                found = [block.ids(i) for i in range(len(tokens))]
                columns = [
                    pa.array(block.doc_ids, mask=block.doc_ids == _NO_ID), pa.array(begin + np.cumsum(tokens) - tokens), pa.array(tokens),
                    pa.array([zlib.crc32(x.astype("<u4")) for x in found], pa.int64()),
                ]
                if ids:
                    ends = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    placed = blocks.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("begin"), "payload")
    return shared.arrow_map(placed, run, schema)
