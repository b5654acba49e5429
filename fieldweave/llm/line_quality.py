"""Quality rules, line first: judge each line, take out those that fail, then judge what is left.

A line fails for its punctuation if it is short and does not end like a sentence, or if too many of its words
hold runs of symbols or end in runs of exclamation marks; for navigation if it is a bar of words between
upright bars; and if it is short and has a boilerplate phrase. A document is rejected for its own figures
(few words, much repetition) or when its failing lines held too many of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text_kernel import SPACE, byte_set, repeated, shingles, text_slices, words

SYMBOLS = b"#*$%&|<>"

# What a sentence ends with, its closing quotes and brackets included.
SENTENCE_ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "]", "\u2026", "\u201d", "\u2019", "\u00bb", "\u3002", "\uff01", "\uff1f")

# Phrases of pages rather than of prose, in lower case and ASCII, by language.
BOILERPLATE = (
    "accept all cookies",
    "all content on this site",
    "click here to",
    "enable javascript",
    "privacy policy",
    "share this article",
    "sign up for our newsletter",
    "skip to main content",
    "subscribe to our newsletter",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
    "abonnez-vous",
    "accepter tous les cookies",
    "cliquez ici pour",
    "nous utilisons des cookies",
    "alle cookies akzeptieren",
    "hier klicken",
    "newsletter abonnieren",
    "wir verwenden cookies",
    "aceptar todas las cookies",
    "haga clic en",
    "suscribirse al boletin",
    "utilizamos cookies",
)


@dataclass(frozen=True)
class LineRules:
    window: int = 5
    repeat_percent: int = 20
    min_words: int = 10
    mark_percent: int = 30
    bar_percent: int = 15
    min_bars: int = 2
    boilerplate_words: int = 30
    fragment_words: int = 20  # a line of more words need not end like a sentence: it may be cut off
    lost_percent: int = 40
    phrases: tuple[str, ...] = BOILERPLATE


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_lines long, n_lost_words long, "
    "base_failed boolean, kept boolean, clean_text string"
)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def judge(column: pa.Array, rules: LineRules) -> dict[str, np.ndarray | pa.Array]:
    """The figures of each text."""
    w = words(column)
    data, offsets, n_docs = w.data, w.offsets, w.n_docs
    n_words = np.diff(w.bounds)
    letters = (data & 0xC0) != 0x80  # the first byte of each character
    symbol = byte_set(SYMBOLS)[data]
    word_chars = _sums(letters & ~byte_set(SPACE)[data], offsets)

    lines = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1, offsets[-1:]])) if len(data) else np.zeros(1, np.int64)
    line_of = np.searchsorted(lines, w.start, "right") - 1
    n_lines = len(lines)
    per_line = np.bincount(line_of, minlength=n_lines)
    length = w.end - w.start
    last = data[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
    before = data[np.maximum(w.end - 2, 0)] if len(w.end) else last
    shout = (length >= 2) & (last == ord("!")) & (before == ord("!"))
    bar = (length == 1) & (last == ord("|"))
    run = np.flatnonzero(symbol[:-2] & symbol[1:-1] & symbol[2:]) if len(data) > 2 else np.empty(0, np.int64)
    marked = np.zeros(len(w.start), bool)
    at = np.searchsorted(w.start, run, "right") - 1
    inside = (at >= 0) & (run + 3 <= w.end[at]) if len(w.start) else np.zeros(0, bool)
    marked[at[inside]] = True
    marks = np.bincount(line_of, weights=shout | marked, minlength=n_lines)
    bars = np.bincount(line_of, weights=bar, minlength=n_lines)
    ends_well = np.zeros(len(w.end), bool)
    for mark in SENTENCE_ENDS:
        code = mark.encode()
        same = length >= len(code)
        for back, byte in enumerate(reversed(code), 1):
            same &= data[np.maximum(w.end - back, 0)] == byte
        ends_well |= same
    final = np.searchsorted(line_of, np.arange(n_lines), "right") - 1  # each line's last word
    fragment = (per_line > 0) & (per_line <= rules.fragment_words)
    fragment[fragment] = ~ends_well[final[fragment]]
    fails = fragment | (100 * marks > rules.mark_percent * per_line) | ((bars >= rules.min_bars) & (100 * bars > rules.bar_percent * per_line))
    small = data.tobytes().lower()
    for phrase in rules.phrases:
        key, at = phrase.encode(), -1
        while (at := small.find(key, at + 1)) >= 0:
            k = np.searchsorted(lines, at, "right") - 1
            if per_line[k] <= rules.boilerplate_words and (k + 1 == n_lines or at + len(key) <= lines[k + 1]):
                fails[k] = True
    fails &= per_line > 0
    line_doc = np.searchsorted(offsets, lines, "right") - 1
    line_doc = np.minimum(line_doc, max(n_docs - 1, 0))
    lost_lines = np.bincount(line_doc, weights=fails, minlength=n_docs).astype(np.int64) if n_docs else np.zeros(0, np.int64)
    lost_words = np.bincount(line_doc, weights=np.where(fails, per_line, 0), minlength=n_docs).astype(np.int64) if n_docs else np.zeros(0, np.int64)

    key, begin = shingles(w, rules.window)
    twice = begin[repeated(w.doc[begin], key)]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + rules.window, -1)
    repeat_words = _sums(np.cumsum(cover[:-1]) > 0, w.bounds)

    dup_lines, clean = np.zeros(n_docs, np.int64), []
    raw = data.tobytes()
    first_line = np.searchsorted(lines, offsets)
    for d in range(n_docs):
        text = raw[offsets[d] : offsets[d + 1]]
        parts = text.split(b"\n")
        if len(set(parts)) < len(parts):
            full = [x for x in parts if x.strip(SPACE)]
            dup_lines[d] = len(full) - len(set(full))
        if lost_lines[d]:
            ends = [*lines[first_line[d] : first_line[d + 1]], offsets[d + 1]]
            text = b"".join(raw[a:b] for a, b, k in zip(ends, ends[1:], range(first_line[d], first_line[d + 1])) if not fails[k])
        clean.append(text)
    base_failed = (n_words < rules.min_words) | (100 * repeat_words > rules.repeat_percent * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(symbol, offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "n_lost_lines": lost_lines, "n_lost_words": lost_words,
        "base_failed": base_failed, "kept": ~base_failed & (100 * lost_words <= rules.lost_percent * n_words), "clean_text": pa.array(clean, pa.binary()).cast(pa.string()),
    }


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), *, text_out: bool = True) -> DataFrame:
    """docs with the figures of each text, the verdict `kept`, and clean_text: the text without failing lines.

    Null and empty texts have no words and fail for that. Rows are judged one by one, so repeated rows get
    the same verdict. Columns of docs that have the name of a figure are replaced.
    """
    made = [x.split()[0] for x in FIGURES.split(", ")]
    shared.small_batches(docs.sparkSession)
    source = docs.drop(*made)
    if not text_out:
        made = made[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", " + ", ".join(FIGURES.split(", ")[: len(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                found = judge(part.column("text"), rules)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[x]) for x in made)], [*part.schema.names, *made])

    return shared.arrow_map(source, run, schema)


def cleaned(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that the rules keep, without their failing lines, with the columns of docs; n_chars follows the text.

    Null and empty texts are rejected; repeated rows fare alike. Columns of docs keep their values, whatever their names.
    """
    plain, own = shared.set_aside(docs, [x.split()[0] for x in FIGURES.split(", ")])
    found = line_quality(plain, rules).filter("kept")
    text = {"text": F.col("clean_text")} | ({"n_chars": F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return own(found.withColumns(text))
