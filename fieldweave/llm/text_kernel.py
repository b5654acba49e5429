"""Words, 64-bit word hashes and shingles of a column of texts, by numpy over the column's own bytes.

All functions take texts as UTF-8 bytes. Work on a column goes by slices of a few MB, so that the
memory of a task does not follow the size of its partition; one text is always in one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
U = np.uint64


def byte_set(members: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[np.frombuffer(members, np.uint8)] = True
    return lut


NOT_SPACE = ~byte_set(SPACE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def steps(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit integers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 20)) * U(0x9E3779B97F4A7C15))


BYTE_CODE = steps(1, 256)
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(max(n, 256) * 2, U(0x9E3779B97F4A7C55))]), dtype=U)
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends. Null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Word w is data[start[w]:end[w]]; those of text d have the numbers bounds[d] to bounds[d + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, step: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        out = np.empty(len(self.start), U)
        length = self.end - self.start
        total = np.concatenate([[0], np.cumsum(length)])
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(total, total[first] + step, "right")) - 1)
            n, begin = length[first:last], total[first:last] - total[first]
            rank = np.arange(total[last] - total[first]) - np.repeat(begin, n)
            at = np.repeat(self.start[first:last], n) + rank
            value = np.add.reduceat(BYTE_CODE[self.data[at]] * powers(int(n.max()))[rank], begin)
            out[first:last] = mix(value + n.astype(U))
            first = last
        return out


def words(column: pa.Array, member: np.ndarray = NOT_SPACE, data: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes for which `member` holds; they never cross from a text into the next.

    data: stands for the column's bytes, of the same length (such as its lower case).
    """
    own, offsets = text_bytes(column)
    data = own if data is None else data
    inside = member[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], ends[last] = inside[first], inside[last]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets))


def shingles(found: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, and the number of the word at which each begins."""
    h = found.hashes() if hashes is None else hashes
    if len(h) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    value = np.zeros(len(h) - n + 1, U)
    for i, factor in enumerate(steps(2, n) | U(1)):
        value += mix(h[i : len(h) - n + 1 + i] + factor) * factor
    at = np.flatnonzero(found.doc[: len(value)] == found.doc[n - 1 :])
    return mix(value[at]), at


def repeated(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each row, whether another one has the same group and key."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, key), sorted, and how often each occurs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(k), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return g[at], k[at], np.diff(np.append(at, len(k)))
