"""Exact deduplication by Grace hashing.

Map side: each task keeps an open-addressing table of the normalised contents it has met and sends one
record for each, so that thousands of copies leave a task as one. Those records are dealt out by hash.
Reduce side: a task puts its records into the same kind of table; when distinct contents exceed the
budget, it partitions the records to spill files by the next bits of the hash and takes each file by
itself, again and again, until each fits. The table compares complete contents; hashes only choose slots.
Copies then find their group by the digest of the content, in a join whose hot keys Spark can split.

Spill files live in the task's temporary folder and go before the task ends, like Spark's own spills;
a lost executor's task runs anew from the shuffle.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text_kernel import SPACE, text_slices

FANOUT_BITS = 4
RECORDS = "digest binary, content binary, copies long, keep_chars long, keep_id long"
GROUPS = "digest binary, keep_id long, group_size long"
_HEAD = struct.Struct("<QQqqq")
_NO_ID = 2**63 - 1


class ContentTable:
    """Open addressing with linear probing; an entry is (digest, content, copies, most characters, id of the row to keep)."""

    def __init__(self) -> None:
        self.slots = np.full(64, -1, np.int64)
        self.rows: list[list] = []
        self.size = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (row := self.slots[at]) >= 0:
            entry = self.rows[row]
            if entry[1] == content:
                break
            if entry[0] == digest:
                raise ValueError("two different texts have the same SHA-256 digest")
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, copies: int, chars: int, doc_id: int) -> None:
        at = self._slot(digest, content)
        if (row := self.slots[at]) >= 0:
            entry = self.rows[row]
            entry[2] += copies
            if (-chars, doc_id) < (-entry[3], entry[4]):
                entry[3:] = [chars, doc_id]
            return
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, copies, chars, doc_id])
        self.size += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for i, entry in enumerate(self.rows):
                self.slots[self._slot(entry[0], entry[1])] = i


def _write(file, record: Iterable) -> None:
    digest, content, copies, chars, doc_id = record
    file.write(_HEAD.pack(len(digest), len(content), copies, chars, doc_id))
    file.write(digest)
    file.write(content)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as file:
        while head := file.read(_HEAD.size):
            a, b, *rest = _HEAD.unpack(head)
            yield (file.read(a), file.read(b), *rest)


def grace(records: Iterable[tuple], budget: int, level: int = 0) -> Iterator[list]:
    """One entry for each distinct content, from tables of about `budget` bytes."""
    table, records = ContentTable(), iter(records)
    for record in records:
        table.add(*record)
        if table.size > budget and len(table.rows) > 1 and level < 64 // FANOUT_BITS - 2:
            break
    else:
        yield from table.rows
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [f"{folder}/{i}" for i in range(1 << FANOUT_BITS)]
        files = [open(name, "wb") for name in names]
        try:
            for part in (table.rows, records):
                for record in part:
                    bits = int.from_bytes(record[0][:8], "little") >> (level * FANOUT_BITS)
                    _write(files[bits & (len(files) - 1)], record)
            table = None
        finally:
            for file in files:
                file.close()
        for name in names:
            yield from grace(_read(name), budget, level + 1)
            os.unlink(name)


def _batches(rows: Iterable[list], fields: tuple[int, ...], names: list[str], types: list, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in part], t) for i, t in zip(fields, types)], names)

    for row in rows:
        part.append(row)
        size += len(row[1]) + 100
        if size > most:
            yield batch()
            part, size = [], 0
    if part:
        yield batch()


def _collapse(budget: int):
    names, types = ["digest", "content", "copies", "keep_chars", "keep_id"], [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for part in text_slices(batch):
                ids, chars, texts = (part.column(x).to_pylist() for x in ("doc_id", "chars", "text"))
                for doc_id, n, text in zip(ids, chars, texts):
                    content = text.encode().translate(None, SPACE)
                    table.add(hashlib.sha256(content).digest(), content, 1, n, _NO_ID if doc_id is None else doc_id)
                if table.size > budget:
                    yield from _batches(table.rows, range(5), names, types)
                    table = ContentTable()
        yield from _batches(table.rows, range(5), names, types)

    return run


def _reduce(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (row for batch in batches for part in text_slices(batch, "content") for row in zip(*(part.column(i).to_pylist() for i in range(5))))
        found = ([x[0], b"", x[2], x[3], None if x[4] == _NO_ID else x[4]] for x in grace(records, budget))
        yield from _batches(found, (0, 4, 2), ["digest", "keep_id", "group_size"], [pa.binary(), pa.int64(), pa.int64()], 2 << 20)

    return run


def content_groups(docs: DataFrame, *, budget: int = 48 << 20) -> DataFrame:
    """(digest, keep_id, group_size) of each distinct normalised content."""
    shared.small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("chars", F.char_length("text").cast("long"))
    records = shared.arrow_map(source, _collapse(budget // 2), RECORDS)
    return shared.arrow_map(records.repartition("digest"), _reduce(budget), GROUPS)


def exact_groups(docs: DataFrame, *, budget: int = 48 << 20) -> DataFrame:
    """Each row of docs with the group of texts that equal its own without white space.

    Adds keep_id (of the longest original text, then the smallest doc_id), group_size, kept and text_sha256.
    Null texts count as empty; all empty ones are one group. Rows with a null doc_id come after all others
    in a tie, and keep_id is null where only such rows are in a group. If one doc_id occurs in several rows
    of a group and is the one to keep, all of these are kept: nothing tells them apart. Columns of these
    names in docs are replaced.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = docs.drop(*made)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    rest = rest.withColumn("text_sha256", F.sha2(plain, 256))
    groups = content_groups(docs, budget=budget)
    groups = groups.select(F.lower(F.hex("digest")).alias("_digest"), "keep_id", "group_size")
    joined = rest.join(groups, rest["text_sha256"] == groups["_digest"], "left").drop(groups["_digest"])
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*[c for c in rest.columns if c != "text_sha256"], *made)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with the columns of docs.

    One row of each group of texts that are equal without white space stays, null and empty ones being one
    group; rows that tie in length and doc_id all stay. Columns of docs keep their values, whatever their names.
    """
    plain, own = shared.set_aside(docs, ["keep_id", "group_size", "kept", "text_sha256"])
    return own(exact_groups(plain, **options).filter("kept"))
