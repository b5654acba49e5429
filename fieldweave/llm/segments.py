"""Tokenization by segments: texts are cut at single spaces, each distinct segment is encoded once and looked up after that.

A cut before a space is sound for a tokenizer that splits text into runs of white space and runs of other
characters before it merges, as long as no other white space touches that space; texts where it does are
cut by longer runs. Tables are bounded: a full one is emptied.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

# The characters that Unicode calls white space, which is what tokenizers' patterns call so.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TOUCHING = re.compile(r"\s\s")  # some more characters than those, which only makes it cut by runs more often
_RUNS = re.compile(rf"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


#: Begins the key of a segment that stands at the beginning of its text, without a space before it.
FIRST = "\0"
#: Begins the key of a whole text that must not be cut.
WHOLE = "\1"


def spaced_segments(text: str) -> list[str]:
    """Keys of the parts of text: a part with its space before it left out, or FIRST and a part as it is."""
    if FIRST in text or _TOUCHING.search(text):
        return [FIRST + x for x in _RUNS.findall(text)]
    out = text.split(" ")
    out[0] = FIRST + out[0]
    return out


def spaced_text(key: str) -> str:
    return key[1:] if key[:1] == FIRST else " " + key


def word_segments(text: str) -> list[str]:
    """Parts of text between spaces and line ends, for tokenizers that drop white space and case; ASCII text already in lower case."""
    return (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")


class _Numbers(dict):
    """Numbers keys in the order in which they come up; `new` has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class SegmentEncoder:
    """Encodes batches of texts by a function from distinct segments to their lists of ids.

    whole: whether a text must not be cut. most: segments in the table before it is emptied, or so many
    characters for each 16 of them; a segment takes some 200 bytes.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], cut: Callable[[str], list[str]], whole: Callable[[str], bool] | None = None, most: int = 600_000) -> None:
        self.encode, self.cut, self.whole, self.most = encode, cut, whole, most
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers()
        self.flat = array("I")
        self.lengths = array("I")
        self.chars = 0

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's begin and the last's end."""
        if len(self.number) > self.most or self.chars > 16 * self.most:
            self._clear()
        parts, counts, cut, whole = [], [], self.cut, self.whole
        for text in texts:
            found = [] if not text else [WHOLE + text] if whole and whole(text) else cut(text)
            parts += found
            counts.append(len(found))
        at = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        if new := self.number.new:
            for ids in self.encode(new):
                self.flat.extend(ids)
                self.lengths.append(len(ids))
            self.chars += sum(map(len, new))
            self.number.new = []
        if not len(at):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lengths = np.frombuffer(self.lengths, np.uint32).astype(np.int64)
        begin, length = (np.cumsum(lengths) - lengths)[at], lengths[at]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = np.frombuffer(self.flat, np.uint32)[np.arange(total[-1]) - np.repeat(total[:-1] - begin, length)] if len(self.flat) else np.empty(0, np.uint32)
        return ids, total[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]


# Fixed value: the characters that byte-level vocabularies write for bytes; printable ones stand for themselves.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(256)}


class _Pieces(dict):
    """The ids of pieces that the tokenizer's pattern does not cut, by its model alone; emptied when it has more than `most`."""

    def __init__(self, library, most: int = 200_000) -> None:
        self.library, self.most = library, most
        self.model = library.model

    def __missing__(self, piece: str) -> list[int]:
        if len(self) > self.most:
            self.clear()
        written = piece if piece.isascii() and " " not in piece else "".join(map(BYTE_CHARS.__getitem__, piece.encode()))
        self[piece] = ids = [x.id for x in self.model.tokenize(written)]
        return ids


class LibraryEncoder:
    """The tokenizers library over many segments at once.

    Most segments are Latin letters and marks after them, which are two pieces for any pattern that tells letters, marks and
    white space apart; pieces are looked up, and the library's model encodes those that are new. Segments of other kinds go
    through the whole library, joined by a special token, which keeps them apart. A text that has the name of a
    special token, in whatever case, is encoded whole, so that the library finds in it what it finds; so is
    one that begins like the key of a whole text.
    """

    #: Letters whose lower case and composition are plain, and marks that no pattern joins to letters or cuts; perhaps twice, in two lines.
    PLAIN = re.compile(r'(\0?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*()/"-]*)(?:\n([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*()/"-]*))?')

    def __init__(self, path: str, text_of: Callable[[str], str] = str, at_once: int = 1000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.text_of, self.at_once = Tokenizer.from_file(path), text_of, at_once
        self.spaced = text_of is not str
        self.pieces = _Pieces(self.library)
        self.lower = self.library.normalizer is not None
        self.special = {x.content: n for n, x in self.library.get_added_tokens_decoder().items()}
        self.mark = next(iter(self.special))
        self.named = re.compile("|".join(map(re.escape, [WHOLE, *self.special])), re.IGNORECASE).search
        self.firsts = sorted({c for x in [WHOLE, *self.special] for c in (x[0].lower(), x[0].upper())})

    def whole(self, text: str) -> bool:
        return any(c in text for c in self.firsts) and self.named(text) is not None

    def _all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_library(self, keys: list[str]) -> Iterator[np.ndarray]:
        for i in range(0, len(keys), self.at_once):
            part = keys[i : i + self.at_once]
            if any(x[:1] == WHOLE for x in part):
                yield from self._all([x[1:] if x[:1] == WHOLE else self.text_of(x) for x in part])
                continue
            ids = self._all([self.mark.join(map(self.text_of, part))])[0]
            marks = np.flatnonzero(ids == self.special[self.mark])
            for a, b in zip([0, *(marks + 1)], [*marks, len(ids)]):
                yield ids[a:b]

    def __call__(self, keys: list[str]) -> Iterator[Iterable[int]]:
        pieces, plain, spaced, found, rest = self.pieces, self.PLAIN.fullmatch, self.spaced, [], []
        for key in keys:
            if (cut := plain(key.lower() if self.lower else key)) and (spaced or key[0] != FIRST):
                first, letters, marks, line, more = cut.groups()
                ids = pieces[f" {letters}" if spaced and not first else letters]
                if marks:
                    ids = ids + pieces[marks]
                if line:
                    ids = ids + (pieces["\n"] if spaced else []) + pieces[line] + (pieces[more] if more else [])
                found.append(ids)
            else:
                found.append(None)
                rest.append(key)
        others = self._by_library(rest)
        for ids in found:
            yield next(others) if ids is None else ids


@lru_cache(maxsize=2)
def library_encoder(path: str, *, spaced: bool) -> SegmentEncoder:
    """By a tokenizer file, one for all tasks of a worker process; spaced: white space and case count."""
    library = LibraryEncoder(path, spaced_text if spaced else str)
    return SegmentEncoder(library, spaced_segments if spaced else word_segments, library.whole)
