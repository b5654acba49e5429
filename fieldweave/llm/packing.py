"""Packing of token sequences into fixed windows, online, by the sum-of-squares rule.

A document's whole windows go out as they are. What remains of it is put where it leaves the least sum of
squared counts of partially filled windows, over all fill levels; an array counts the open windows at
each level, however many there are. Their ids are held in memory up to a budget and in a file of the task beyond it. When a
task ends, the emptiest open windows are cut into the room of the fullest, and the last is cut into powers of
two, which need no padding. Each task packs its own part of the table, so nothing is shuffled.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import shared
from .segments import library_encoder
from .text_kernel import text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class PieceStore:
    """The ids of pieces in open windows. Those beyond `budget` bytes of memory are in a temporary file, which goes with the task."""

    def __init__(self, budget: int) -> None:
        self.budget, self.used, self.file = budget, 0, None

    def put(self, ids: np.ndarray) -> np.ndarray | tuple[int, int]:
        if self.used + ids.nbytes <= self.budget:
            self.used += ids.nbytes
            return ids.copy()
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="packing-")
        at = self.file.seek(0, 2)
        self.file.write(ids.astype("<u4").tobytes())
        return at, len(ids)

    def take(self, stored: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(stored, np.ndarray):
            self.used -= stored.nbytes
            return stored
        self.file.seek(stored[0])
        return np.frombuffer(self.file.read(4 * stored[1]), "<u4")

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class WindowPacker:
    """add() gives the windows that a document closes, finish() all others. A piece is (document number, its ids before the piece, ids)."""

    def __init__(self, window: int = 2048, budget: int = 48 << 20) -> None:
        self.window, self.store = window, PieceStore(budget)
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list[tuple]]:
        window, rest = self.window, len(ids) % self.window
        whole = len(ids) - rest
        for at in range(0, whole, window):
            yield [(doc, at, ids[at : at + window])]
        if rest:
            yield from self._place((doc, whole, self.store.put(ids[whole:])), rest)

    def _place(self, piece: tuple, size: int) -> Iterator[list[tuple]]:
        count, window = self.count, self.window
        # Half the change of the sum of squares; full windows no longer count.
        change = count[size:] - count[: window - size + 1] + 1.0
        change[count[: window - size + 1] == 0] = np.inf
        change[-1] -= 0.5
        level = window - size - int(np.argmin(change[::-1]))
        if change[level] < count[size] + 0.5:
            pieces = self.open[level].pop()
            count[level] -= 1
        else:
            pieces, level = [], 0
        pieces.append(piece)
        level += size
        if level == window:
            yield self._taken(pieces)
        else:
            self.open.setdefault(level, []).append(pieces)
            count[level] += 1

    def _taken(self, pieces: list[tuple]) -> list[tuple]:
        return [(doc, start, self.store.take(ids)) for doc, start, ids in pieces]

    def finish(self) -> Iterator[list[tuple]]:
        """The fullest open windows filled with pieces of the emptiest; the last one cut into powers of two."""
        queue = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.count[:] = 0
        self.open = {}
        spare: list[tuple] = []
        first, end = 0, len(queue)
        while first < end:
            level, pieces = queue[first]
            pieces = self._taken(pieces)
            first += 1
            while level < self.window and (spare or first < end):
                if not spare:
                    end -= 1
                    spare = self._taken(queue[end][1])
                doc, start, ids = spare.pop()
                room = self.window - level
                pieces.append((doc, start, ids[:room]))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:]))
                level += min(room, len(ids))
            if level == self.window:
                yield pieces
            else:
                yield from self._by_powers(pieces, level)
        if spare:  # the last window taken apart was not used up
            yield from self._by_powers(spare, sum(len(x[2]) for x in spare))
        self.store.close()

    def _by_powers(self, pieces: list[tuple], level: int) -> Iterator[list[tuple]]:
        pieces = pieces[::-1]
        while level:
            room = 1 << (level.bit_length() - 1)
            level -= room
            out = []
            while room:
                doc, start, ids = pieces.pop()
                out.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield out


def packed(docs: DataFrame, tokenizer: str, *, end_id: int = 1, window: int = 2048, ids: bool = True, budget: int = 48 << 20) -> DataFrame:
    """The pieces of all documents in windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Null and empty texts have the end id alone. Rows are packed one by one, so repeated rows each have their
    own pieces, with the same doc_id; a null doc_id stays null. sequence_id is unique in the table and the
    same if a task runs again: it joins the task's number and the window's number in it. budget: bytes of ids of
    open windows that a task holds in memory; the pieces are the same for any.
    """
    shared.small_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, known = library_encoder(tokenizer, spaced=True), WindowPacker(window, budget), {}
        sequence, n_docs, closed = TaskContext.get().partitionId() << 33, 0, []

        def out() -> pa.RecordBatch:
            nonlocal sequence, closed
            rows = []
            for pieces in closed:
                offset = 0
                for doc, start, part in pieces:
                    doc_id, total, left = known[doc]
                    rows.append((doc_id, start, len(part), zlib.crc32(part), total, sequence, offset, part))
                    offset += len(part)
                    if left == len(part):
                        del known[doc]
                    else:
                        known[doc] = (doc_id, total, left - len(part))
                sequence += 1
            closed = []
            columns = [pa.array([x[i] for x in rows], pa.int64()) for i in range(7)]
            if ids:
                flat = np.concatenate([x[7] for x in rows]) if rows else np.empty(0, np.uint32)
                ends = np.concatenate([[0], np.cumsum([len(x[7]) for x in rows], dtype=np.int64)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in text_slices(batch):
                found, ends = encode.batch(part.column("text").to_pylist())
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
                    known[n_docs] = (doc_id, b - a + 1, b - a + 1)
                    closed += packer.add(n_docs, np.append(found[a:b], np.uint32(end_id)))
                    n_docs += 1
                yield out()
        for pieces in packer.finish():
            closed.append(pieces)
            if len(closed) >= 256:
                yield out()
        yield out()

    return shared.arrow_map(docs.select("doc_id", "text"), run, schema)
