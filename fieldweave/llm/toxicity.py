"""Toxicity of texts by a learned lexicon: misspelled terms by Levenshtein automata over a trie, hits weighed by their context.

The lexicon comes from labelled documents: words and word beginnings (stems) that toxic documents have much more
often than others, each with the lower bound of its log odds as weight. All its words are one trie. A word of a
text runs through the Levenshtein automata of all of them at once: a state is a set of (trie node, edits so far),
made when it is first met, so that a word costs one lookup for each of its characters. Words that clean documents
have are no misspellings. A hit weighs less in quotation marks or after a verb of saying, and that is made up for
where somebody is addressed. A logistic curve over the hits' sum, density and greatest weight gives the score.

Learning reads a bounded sample of the labelled rows (`ToxicityOptions.sample_docs`); scoring reads every text whole.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .text_kernel import text_slices

# Characters that stand for letters, quotation marks, verbs of saying and words of address in four languages.
_LETTERS = str.maketrans("0134578@$", "oieastbas")
_QUOTES = "\"“”„‟«»‹›"
_SAYING = frozenset("said says say saying called calls wrote writes quoted quote quotes word words term slur sagte sagt nannte schrieb wort zitat dit disait appelé écrit mot dijo dice llamó escribió palabra".split())
_ADDRESS = frozenset("you your you're youre u ur du dich dein deine sie tu te toi ton vous tú usted eres".split())

_MARKS = string.punctuation + _QUOTES + "‘’‚‛…–—¡¿·•†‡§"
_QUOTE_SET = frozenset(_QUOTES)
_SPELLED = re.compile(r"(?:\w[\W_])+\w")
_DRAWN_OUT = re.compile(r"(\w)\1{2,}")


@dataclass(frozen=True)
class ToxicityOptions:
    """sample_docs: labelled rows to learn from, those of the least hashes of their ids. most_terms: the size of the lexicon at most."""

    sample_docs: int = 12_000
    most_terms: int = 4_000
    least_docs: int = 3
    sureness: float = 1.64
    least_weight: float = 1.0
    stems: tuple[int, int] = (3, 9)
    window: int = 8
    quoted: float = 0.4
    reported: float = 0.6
    addressed: float = 1.5
    per_edit: float = 0.6
    ridge: float = 1.0


@dataclass(frozen=True)
class Lexicon:
    """words and stems with their weights; clean: words of clean documents that are near a word of the lexicon, but not misspelled."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    curve: tuple[float, ...]
    options: ToxicityOptions


def plain_word(token: str) -> str:
    """A lower-case token without what stands around the word."""
    return token.strip(_MARKS)


def spelled_out(word: str) -> str:
    """The word with letters for what stands for them, no letter drawn out, no marks between single letters."""
    if _SPELLED.fullmatch(word):
        word = re.sub(r"[\W_]", "", word)
    if word.isalpha():
        return _DRAWN_OUT.sub(r"\1", word)
    return _DRAWN_OUT.sub(r"\1", word.translate(_LETTERS)) if any(c.isalpha() for c in word) else word


def edits_allowed(word: str) -> int:
    """How many edits a word of the lexicon may be away: short words are near too many others."""
    return 0 if len(word) < 5 else 1 if len(word) < 8 else 2


class Automaton:
    """The words within their numbers of edits, as one deterministic automaton that is made while it runs.

    An edit is a character more, less or other, or two neighbours swapped. The first character must be right.
    A state is a set of (node, edits, character still to come of a swap); it keeps the fewest edits of each.
    """

    def __init__(self, words: Iterable[str], most_states: int = 100_000) -> None:
        self.most_states = most_states
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.reach = [0]  # the most edits that a word below allows
        for word in sorted(words):
            node = 0
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits_allowed(word))
            self.word[node] = word
        self._clear()

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.none = self._numbered(frozenset())
        self.start = self._numbered(frozenset([(0, 0, "")]))

    def _numbered(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [(e, self.word[node]) for node, e, swap in state if not swap and self.word[node] is not None and e <= edits_allowed(self.word[node])]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.number[state]

    def _step(self, state: frozenset, c: str) -> int:
        best: dict[tuple[int, str], int] = {}

        def reach(node: int, e: int, swap: str = "") -> None:
            """Into a node, and on to those that characters left out lead to."""
            if e <= self.reach[node] and e < best.get((node, swap), 9):
                best[node, swap] = e
                if not swap:
                    for child in self.children[node].values():
                        reach(child, e + 1)

        for node, e, swap in state:
            if swap:
                if swap == c:
                    reach(node, e)
                continue
            for d, child in self.children[node].items():
                if d == c:
                    reach(child, e)
                elif node:
                    reach(child, e + 1)
                    if c in self.children[child]:
                        reach(self.children[child][c], e + 1, d)
            if node:
                reach(node, e + 1)
        return self._numbered(frozenset((node, e, swap) for (node, swap), e in best.items()))

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The word of the lexicon that takes the fewest edits, the first of equals, and their number."""
        if len(self.states) > self.most_states:
            self._clear()
        at = self.start
        for c in word:
            moves = self.moves[at]
            if c not in moves:
                moves[c] = self._step(self.states[at], c)
            at = moves[c]
            if at == self.none:
                return None
        return self.found[at]


@dataclass(frozen=True)
class Token:
    """What a token of a text means for the score."""

    weight: float = 0.0
    term: str = ""
    edits: int = 0
    opens: bool = False
    closes: bool = False
    saying: bool = False
    address: bool = False


class _Table(dict):
    """Tokens that mean nothing have 0, others their place in `tokens`."""

    def __init__(self, lexicon: Lexicon, options: ToxicityOptions) -> None:
        self.lexicon, self.options = lexicon, options
        self.automaton = Automaton(lexicon.words)
        self.shortest, self.longest = min(map(len, lexicon.stems), default=0), max(map(len, lexicon.stems), default=0)
        self.heads = {stem[: self.shortest] for stem in lexicon.stems}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.tokens = [Token()]

    def looked_up(self, word: str) -> tuple[float, str, int]:
        """The greatest weight of a word: as a word of the lexicon, by a stem, or misspelled."""
        lexicon, best = self.lexicon, (0.0, "", 0)
        if word in lexicon.words:
            best = (lexicon.words[word], word, 0)
        if word[: self.shortest] in self.heads:
            for n in range(min(self.longest, len(word) - 1), self.shortest - 1, -1):
                if (weight := lexicon.stems.get(word[:n], 0.0)) > best[0]:
                    best = (weight, word[:n] + "*", 0)
        if best[0] or len(word) < 4 or word in lexicon.clean:
            return best
        plain = word
        if not word.isalpha() or _DRAWN_OUT.search(word):
            plain = spelled_out(word)
            if plain in lexicon.words:
                return lexicon.words[plain], plain, 0
            if len(plain) < 4 or plain in lexicon.clean:
                return best
        if found := self.automaton.nearest(plain):
            return lexicon.words[found[0]] * self.options.per_edit ** found[1], *found
        return best

    def __missing__(self, token: str) -> int:
        number, word = 0, token.strip(_MARKS)
        if len(token) <= 64:
            weight, term, edits = self.looked_up(word)
            opens = closes = False
            if len(word) < len(token) and not _QUOTE_SET.isdisjoint(token):
                head, _, tail = token.partition(word) if word else (token, "", token)
                opens, closes = not _QUOTE_SET.isdisjoint(head), not _QUOTE_SET.isdisjoint(tail)
            if weight or opens or closes or word in _SAYING or word in _ADDRESS:
                number = len(self.tokens)
                self.tokens.append(Token(weight, term, edits, opens, closes, word in _SAYING, word in _ADDRESS))
        self[token] = number
        return number


class Reader:
    """Finds the hits of texts. Its table of tokens is emptied when it has more than `most`."""

    def __init__(self, lexicon: Lexicon, options: ToxicityOptions, most: int = 300_000) -> None:
        self.table, self.options, self.most = _Table(lexicon, options), options, most

    def hits(self, text: str) -> tuple[int, list[tuple[int, Token, float]]]:
        """The number of tokens; the place of each hit, its token and its weight in its context."""
        table, options = self.table, self.options
        if len(table) > self.most:
            table.empty()
        tokens = text.lower().split()
        codes = np.fromiter(map(table.__getitem__, tokens), np.int64, len(tokens))
        marked = np.flatnonzero(codes)
        if not len(marked):
            return len(tokens), []
        seen = [table.tokens[i] for i in codes[marked]]
        out = []
        for k, token in enumerate(seen):
            if token.weight:
                at = int(marked[k])
                first, last = np.searchsorted(marked, [at - options.window, at + options.window + 1])
                near = [(int(marked[i]) - at, seen[i]) for i in range(first, last)]
                out.append((at, token, token.weight * self._context(near)))
        return len(tokens), out

    def _context(self, near: list[tuple[int, Token]]) -> float:
        """A factor for a hit from the tokens around it: quotation weighs less, abuse addresses somebody."""
        options, factor = self.options, 1.0
        before = [t for d, t in near if d <= 0]
        after = [t for d, t in near if d >= 0]
        open_ = sum(t.opens for t in before) - sum(t.closes for d, t in near if d < 0)
        if open_ > 0 and any(t.closes for t in after):
            factor *= options.quoted
        if any(t.saying for d, t in near if d < 0):
            factor *= options.reported
        if any(t.address for d, t in near if abs(d) <= 3):
            factor = min(1.0, factor * options.addressed)
        return factor

    def features(self, text: str) -> tuple[float, float, float]:
        """Logarithm of the hits' sum, of their sum for each hundred tokens, and the greatest."""
        n, hits = self.hits(text)
        weights = [w for _, _, w in hits]
        total = sum(weights)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(n, 1))), max(weights, default=0.0)


def learned(doc_id=None):
    """Whether a document may be learned from: crc32 of its id as text, modulo 5, isn't 0."""
    key = F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 5 != 0


COUNTS = "term string, stem boolean, toxic0 long, clean0 long, toxic1 long, clean1 long"


def _counted(options: ToxicityOptions):
    """In how many documents of each label and half a word or a beginning of one stands."""
    low, high = options.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(4)]

        def out() -> pa.RecordBatch:
            keys = sorted(set().union(*counts))
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in COUNTS.split(", ")])

        for batch in batches:
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                found = {plain_word(t) for t in text.lower().split() if len(t) <= 64} - {""}
                count = counts[2 * half + (not toxic)]
                count.update((w, False) for w in found)
                count.update({(w[:n], True) for w in found for n in range(low, min(high, len(w) - 1) + 1)})
            if sum(map(len, counts)) > 500_000:
                yield out()
        yield out()

    return run


def _bound(toxic, clean, sizes: tuple[int, int], sureness: float):
    """The lower bound of the log odds of a term, of columns or of numbers."""
    log, sqrt = (F.log, F.sqrt) if not isinstance(toxic, (int, float)) else (np.log, np.sqrt)
    return log((toxic + 0.5) / (clean + 0.5)) + float(np.log((sizes[1] + 1) / (sizes[0] + 1))) - sureness * sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def chosen_terms(rows: list[tuple[str, bool, int, int]], sizes: tuple[int, int], options: ToxicityOptions) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from (term, stem, toxic, clean) rows; what another one explains is left out."""
    weight = {(t, s): float(_bound(float(a), float(b), sizes, options.sureness)) for t, s, a, b in rows if a >= options.least_docs}
    weight = {k: w for k, w in weight.items() if w >= options.least_weight}
    toxic = {(t, s): a for t, s, a, _ in rows}
    words = {t: w for (t, s), w in weight.items() if not s}
    # A stem that one word explains is that word's.
    by_word: dict[str, int] = {}
    for w in words:
        for n in range(options.stems[0], min(options.stems[1], len(w) - 1) + 1):
            by_word[w[:n]] = max(by_word.get(w[:n], 0), toxic[w, False])
    stems = {t: w for (t, s), w in weight.items() if s and by_word.get(t, 0) < 0.8 * toxic[t, True]}
    # Of a stem and a longer one, or a word, the longer one only where it says more.
    shorter = lambda t: max((stems.get(t[:n], 0.0) for n in range(options.stems[0], len(t))), default=0.0)
    kept = {t: w for t, w in stems.items() if shorter(t) < w - 0.2}
    return {t: w for t, w in words.items() if shorter(t) < w - 0.2}, kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Coefficients, the constant first, by Newton's method with a penalty on all others."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ b
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, gradient)
        b = b - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, options: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """A model of labelled rows (doc_id, toxic) that `learned` lets it see.

    A document with several labels is toxic if one says so; null labels and rows without an id or a text don't
    count. Equal texts count once, so that copies prove nothing. Without toxic or without clean rows the lexicon is empty and the score of all is low.
    The curve is fitted on hits of lexicons that come from the other half of the sample.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learned()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most sample_docs rows of two numbers.
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(options.sample_docs)
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    sample = sample.groupBy(F.xxhash64("text").alias("_hash"), F.length("text").alias("_n")).agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"))
    sample = shared.written(sample.select("text", (F.col("toxic") > 0).alias("toxic"), F.pmod("_hash", F.lit(2)).cast("int").alias("half")), "toxicity_sample")
    sizes = {(half, toxic): n for half, toxic, n in sample.groupBy("half", "toxic").count().collect()}
    size = [(sizes.get((h, True), 0), sizes.get((h, False), 0)) for h in (0, 1)]
    whole = (size[0][0] + size[1][0], size[0][1] + size[1][1])
    if not all(whole):
        return ToxicityModel(Lexicon(), (-3.0, 0.0, 0.0, 0.0), options)
    counts = shared.arrow_map(sample, _counted(options), COUNTS).groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in ("toxic0", "clean0", "toxic1", "clean1")))
    counts = shared.written(counts, "toxicity_counts")
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    best = F.greatest(_bound(toxic, clean, whole, options.sureness), *(_bound(F.col(f"toxic{h}"), F.col(f"clean{h}"), size[h], options.sureness) for h in (0, 1)))
    # At most most_terms rows; the strongest, if more are strong enough.
    rows = counts.filter((toxic >= options.least_docs) & (best >= options.least_weight)).orderBy(best.desc(), "term", "stem").limit(options.most_terms).collect()
    halves = [
        chosen_terms([(r.term, r.stem, r.toxic0, r.clean0) for r in rows], size[0], options),
        chosen_terms([(r.term, r.stem, r.toxic1, r.clean1) for r in rows], size[1], options),
        chosen_terms([(r.term, r.stem, r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in rows], whole, options),
    ]
    clean_words = [_clean_neighbours(counts, words, column) for (words, _), column in zip(halves, (F.col("clean0"), F.col("clean1"), clean))]
    lexicons = [Lexicon(words, stems, near) for (words, stems), near in zip(halves, clean_words)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(lexicons[1], options), Reader(lexicons[0], options)]  # a text is read by the other half's
        for batch in batches:
            rows = [readers[h].features(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x) for x in zip(*rows))] if rows else [pa.array([], t) for t in (pa.bool_(), *[pa.float64()] * 3)], ["toxic", "a", "b", "c"])

    # At most sample_docs rows of four numbers.
    seen = np.array(sorted(map(tuple, shared.arrow_map(sample, measured, "toxic boolean, a double, b double, c double").collect())), float)
    curve = logistic(seen[:, 1:], seen[:, 0], options.ridge)
    shared.dropped(spark, sample)
    shared.dropped(spark, counts)
    return ToxicityModel(lexicons[2], tuple(map(float, curve)), options)


def _clean_neighbours(counts: DataFrame, words: dict[str, float], clean) -> frozenset[str]:
    """Words of clean documents that a word of the lexicon is near to: as many as the sample has, found by the automaton."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(words)
        for batch in batches:
            terms = batch.column("term").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([t for t in terms if t not in words and (automaton.nearest(t) or automaton.nearest(spelled_out(t)))], pa.string())], ["term"])

    found = shared.arrow_map(counts.filter(~F.col("stem") & (clean > 0)).select("term"), near, "term string").collect()
    return frozenset(r.term for r in found)


MADE = "held_out boolean, score double, predicted int"
HITS = "hits array<struct<word:int,term:string,edits:int,weight:double>>"


def scored(docs: DataFrame, model: ToxicityModel, *, hits: bool = False) -> DataFrame:
    """docs with held_out, score (0 to 1), predicted (1 from 0.5 on) and, if asked for, hits.

    A hit has the number of its token, the term (a stem ends in `*`), its edits and its weight in its context.
    Null and empty texts have the score of a text without hits. Rows are scored one by one from the text alone,
    so repeated rows fare alike. Columns of docs with the name of one that is made are replaced.
    """
    made = [x.split()[0] for x in MADE.split(", ")] + ["hits"] * hits
    shared.small_batches(docs.sparkSession)
    source = docs.drop(*made).withColumn("held_out", ~learned())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *MADE.split(", ")[1:], *[HITS] * hits])
    hit_type = pa.list_(pa.struct([("word", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, (constant, *slopes) = Reader(model.lexicon, model.options), model.curve
        for batch in batches:
            for part in text_slices(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                x = np.array([reader.features(t) for t in texts])
                score = 1 / (1 + np.exp(-np.clip(constant + x @ np.array(slopes), -30, 30)))
                columns = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                if hits:
                    columns.append(pa.array([[(at, t.term, t.edits, w) for at, t, w in reader.hits(text)[1]] for text in texts], hit_type))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *made[1:]])

    return shared.arrow_map(source, run, schema)
