"""Byte-level BPE encoding and decoding from a file of ranks.

Text is cut by the vocabulary's pattern; each piece starts as bytes and merges its pair of least rank, the
leftmost first, until no pair has a rank. A segment tree over the byte positions of a piece holds at its
root the leftmost least pair; a merge changes the leaves of the live neighbours and the nodes above them.
All pieces of a batch with trees of one size go in step, one merge each, as rows of numpy arrays; where they
are too few for that, as very long pieces are, each goes by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .segments import SegmentEncoder, spaced_segments, spaced_text
from .text_kernel import text_slices

NONE = np.int64(2**62)
SHIFT = np.int64(32)
FEW = 48  # pieces of one size that a step over arrays is not worth


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class RankTree:
    """Merges many pieces at once."""

    def __init__(self, ranks: dict[bytes, int], cells: int = 1 << 20) -> None:
        self.ranks, self.cells = ranks, cells
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.pairs: dict[int, int] = {}

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What a leaf holds for the pair of tokens whose first begins at byte `at`."""
        key = (left << SHIFT) | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, (self.rank[i] << SHIFT) | at, NONE)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in pieces]
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, rows in by_size.items():
            if len(rows) < FEW and size >= 64:
                for i in rows:
                    out[i] = self._merge_one(pieces[i], size)
                continue
            step = max(1, self.cells // size)
            for first in range(0, len(rows), step):
                part = rows[first : first + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], size)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], size: int) -> list[list[int]]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(n, size)
        live = np.arange(size) < length[:, None]
        token = np.where(live, self.byte_id[raw], -1)
        place = np.arange(size)
        following = np.where(place + 1 < length[:, None], place + 1, size)
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE)
        if size > 1:
            pair = live[:, 1:]
            tree[:, size:-1][pair] = self._leaf(token[:, :-1][pair], token[:, 1:][pair], np.broadcast_to(place[:-1], pair.shape)[pair])
        for node in (2**k for k in range(size.bit_length() - 2, -1, -1)):
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])

        def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + size
            tree[rows, node] = value
            while size > 1 and node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            at, merged = root & 0xFFFFFFFF, root >> SHIFT
            right = following[rows, at]
            after = following[rows, right]
            token[rows, at], token[rows, right] = merged, -1
            following[rows, at] = after
            update(rows, right, np.full(len(rows), NONE))
            has = after < size
            value = np.full(len(rows), NONE)
            if has.any():
                before[rows[has], after[has]] = at[has]
                value[has] = self._leaf(merged[has], token[rows[has], after[has]], at[has])
            update(rows, at, value)
            left = before[rows, at]
            has = left >= 0
            if has.any():
                r, l = rows[has], left[has]
                update(r, l, self._leaf(token[r, l], merged[has], l))
            rows = rows[tree[rows, 1] < NONE]
        keep = token >= 0
        flat, ends = token[keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


    def _merge_one(self, piece: bytes, size: int) -> list[int]:
        """The same for one piece, over plain lists. A change goes up the tree until a node stays as it is."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.rank.tolist()))
        pairs, none, n = self.pairs, int(NONE), len(piece)
        token = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for at in range(n - 1):
            rank = pairs.get((token[at] << 32) | token[at + 1])
            if rank is not None:
                tree[size + at] = (rank << 32) | at
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, value: int) -> None:
            node = size + at
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        def leaf(at: int) -> int:
            after = following[at]
            rank = pairs.get((token[at] << 32) | token[after]) if after < n else None
            return none if rank is None else (rank << 32) | at

        while (root := tree[1]) < none:
            at, merged = root & 0xFFFFFFFF, root >> 32
            right = following[at]
            after = following[right]
            token[at], token[right], following[at] = merged, -1, after
            update(right, none)
            if after < n:
                before[after] = at
            update(at, leaf(at))
            if before[at] >= 0:
                update(before[at], leaf(before[at]))
        return [t for t in token if t >= 0]


class PieceEncoder:
    """Ids of segments: their pieces by the pattern, each distinct piece merged once in a while."""

    def __init__(self, path: str, pattern: str, most: int = 250_000) -> None:
        import regex

        self.tree, self.find, self.most = RankTree(read_ranks(path)), regex.compile(pattern).findall, most
        self.known: dict[str, list[int]] = {}

    def __call__(self, keys: list[str]) -> list[list[int]]:
        if len(self.known) > self.most:
            self.known = {}
        cut = [self.find(spaced_text(x)) for x in keys]
        known = self.known
        new = [x for x in dict.fromkeys(p for pieces in cut for p in pieces) if x not in known]
        known.update(zip(new, self.tree.encode([x.encode() for x in new])))
        out = [known[x[0]] if len(x) == 1 else [i for p in x for i in known[p]] for x in cut]
        for x in new:
            if len(x) > 64:
                del known[x]
        return out


class Decoder:
    """Bytes of ids, by one table of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        n = max(ranks.values()) + 1
        tokens = [b""] * n
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, n)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def batch(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin and the last's end."""
        length = self.length[ids]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.data[np.arange(total[-1]) - np.repeat(total[:-1] - self.begin[ids], length)], total


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> SegmentEncoder:
    """One for all tasks of a worker process."""
    return SegmentEncoder(PieceEncoder(path, pattern), spaced_segments)


def bpe_encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """docs with `ids`, the text's token ids. Null and empty texts have none; repeated rows each have theirs. A column ids of docs is replaced."""
    shared.small_batches(docs.sparkSession)
    source = docs.drop("ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        for batch in batches:
            for part in text_slices(batch):
                ids, ends = encode.batch(part.column("text").to_pylist())
                column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "ids"])

    return shared.arrow_map(source, run, schema)


def bpe_decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with `decoded`, the bytes of its ids; a null or empty list decodes to no bytes. A column decoded is replaced."""
    source = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(ranks))
        for batch in batches:
            lists = batch.column("ids").cast(pa.large_list(pa.int32())).fill_null([])
            data, total = decoder.batch(lists.flatten().to_numpy())
            ends = total[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], [*batch.schema.names, "decoded"])

    return shared.arrow_map(source, run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text: what encoding and then decoding its ids give.

    Null and empty texts have no ids and the digests of no bytes; repeated rows each have a row, and a null doc_id
    stays null. Only doc_id and text are used.
    """
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decoder = encoder(ranks, pattern), Decoder(read_ranks(ranks))
        for batch in batches:
            for part in text_slices(batch):
                ids, ends = encode.batch(part.column("text").to_pylist())
                data, total = decoder.batch(ids)
                spans = list(zip(ends.tolist(), ends[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(ends)), pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans], pa.string()),
                        pa.array([hashlib.sha256(data[total[a] : total[b]]).hexdigest() for a, b in spans], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return shared.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
