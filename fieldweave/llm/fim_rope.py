"""Fill-in-the-middle transformation of texts held as ropes.

A text is a balanced tree of leaves of some 256 units (a word with the white space before it). Each node caches how many
units and code points are below it, so a split at a unit's rank or at a code point walks one path down, shares all
other subtrees and cuts one leaf at most. A document is split at two ranks; the three subtrees and leaves with the
sentinels are concatenated in the order of its form. The way back makes a rope of the output, splits it around the
sentinels and concatenates what is between them in the text's order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .text_kernel import text_slices

_S = r"\x20\x09-\x0D"
UNIT = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
_LEAF = re.compile(f"(?:[{_S}]*[^{_S}]+){{1,256}}|[{_S}]+")
LEAF_CHARS = 2048

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class FimOptions:
    """rate and spm: percent of documents that are transformed, and of those the percent with the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("the sentinels must be three texts, none part of another")
        if any(a.endswith(b[:n]) for a in marks for b in marks for n in range(1, len(b) + (a is not b)) if n < len(b)):
            raise ValueError("no sentinel may begin as one ends")


class Rope:
    """A node: either a leaf with text, or two subtrees."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str = "", units: int | None = None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        if left is None or right is None:
            self.units = len(UNIT.findall(text)) if units is None else units
            self.chars, self.height = len(text), 0
        else:
            self.units, self.chars = left.units + right.units, left.chars + right.chars
            self.height = 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope("", 0)


def joined(a: Rope, b: Rope) -> Rope:
    """a and b as one rope, of which no subtree is much higher than its neighbour."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Rope(left=a, right=b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """The node of a and b, turned once or twice where one is two levels higher."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


def built(leaves: list[Rope]) -> Rope:
    """A balanced rope of leaves."""
    if not leaves:
        return EMPTY
    while len(leaves) > 1:
        leaves = [Rope(left=leaves[i], right=leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def rope_of_units(text: str) -> Rope:
    """A rope whose leaves are whole units."""
    return built([Rope(m.group()) for m in _LEAF.finditer(text)])


def rope_of_chars(text: str) -> Rope:
    """A rope to be split by code points; its units are not counted."""
    return built([Rope(text[i : i + LEAF_CHARS], 0) for i in range(0, len(text), LEAF_CHARS)])


def split_units(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if rope.left is None:
        at = next(m.end() for i, m in enumerate(UNIT.finditer(rope.text), 1) if i == rank)
        return Rope(rope.text[:at], rank), Rope(rope.text[at:], rope.units - rank)
    if rank <= rope.left.units:
        a, b = split_units(rope.left, rank)
        return a, joined(b, rope.right)
    a, b = split_units(rope.right, rank - rope.left.units)
    return joined(rope.left, a), b


def split_chars(rope: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest; units are not counted any more."""
    if at <= 0:
        return EMPTY, rope
    if at >= rope.chars:
        return rope, EMPTY
    if rope.left is None:
        return Rope(rope.text[:at], 0), Rope(rope.text[at:], 0)
    if at <= rope.left.chars:
        a, b = split_chars(rope.left, at)
        return a, joined(b, rope.right)
    a, b = split_chars(rope.right, at - rope.left.chars)
    return joined(rope.left, a), b


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: Rope


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers from the seed and the id, the same everywhere."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(doc_id: int | None, text: str, options: FimOptions) -> Transformed:
    rope, (a, b, chance, order) = rope_of_units(text), numbers(doc_id, options.seed)
    n = rope.units
    if not text or chance % 100 >= options.rate or any(x in text for x in (options.prefix, options.suffix, options.middle)):
        return Transformed(n, PLAIN, None, None, rope)
    first, second = sorted((a % (n + 1), b % (n + 1)))
    prefix, rest = split_units(rope, first)
    middle, suffix = split_units(rest, second - first)
    p, s, m = (Rope(x, 0) for x in (options.prefix, options.suffix, options.middle))
    form = SPM if order % 100 < options.spm else PSM
    parts = [s, suffix, p, prefix, m, middle] if form == SPM else [p, prefix, s, suffix, m, middle]
    *_, output = accumulate(parts, joined)
    return Transformed(n, form, prefix.chars, middle.chars, output)


def restore(output: str, form: str, options: FimOptions) -> str:
    """The text, from the output and its form alone."""
    if form == PLAIN:
        return output
    first, second = (options.suffix, options.prefix) if form == SPM else (options.prefix, options.suffix)
    if not output.startswith(first):
        raise ValueError("not an output of this form")
    one = output.index(second, len(first))
    two = output.index(options.middle, one + len(second))
    rope = rope_of_chars(output)
    rest, middle = split_chars(rope, two + len(options.middle))
    rest, _ = split_chars(rest, two)
    head, tail = split_chars(rest, one + len(second))
    head, _ = split_chars(head, one)
    _, head = split_chars(head, len(first))
    prefix, suffix = (tail, head) if form == SPM else (head, tail)
    return str(joined(joined(prefix, middle), suffix))


MADE = "n long, form string, prefix_chars long, middle_chars long"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _mapped(docs: DataFrame, made: str, columns, sliced: str = "text") -> DataFrame:
    """docs with the columns of `made`, which columns(row batch) gives; columns of docs with these names are replaced."""
    names = [x.split()[0] for x in made.split(", ")]
    shared.small_batches(docs.sparkSession)
    source = docs.drop(*names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, sliced):
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(part)], [*part.schema.names, *names])

    return shared.arrow_map(source, run, schema)


def _rows(part: pa.RecordBatch, options: FimOptions) -> list[Transformed]:
    return [transform(i, t or "", options) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())]


def transformed(docs: DataFrame, options: FimOptions = FimOptions()) -> DataFrame:
    """docs with n (units of the text), form, prefix_chars, middle_chars and output.

    Null and empty texts, texts that contain a sentinel and the share that `rate` leaves out are `plain`: their
    output is the text, empty for null, and the two lengths are null. What becomes of a row depends on its id and text
    alone, so repeated rows fare alike; a null id counts as an empty one. Columns of docs with the name of one that is made are replaced.
    """

    def columns(part: pa.RecordBatch) -> list[pa.Array]:
        rows = _rows(part, options)
        values = zip(*((x.n, x.form, x.prefix_chars, x.middle_chars, str(x.output)) for x in rows))
        return [pa.array(v, t) for v, t in zip(values, [*_TYPES, pa.string()])]

    return _mapped(docs, f"{MADE}, output string", columns)


def restored(docs: DataFrame, options: FimOptions = FimOptions()) -> DataFrame:
    """docs, which have output and form, with restored: the text that `transformed` had. Null where the output or the form is."""

    def columns(part: pa.RecordBatch) -> list[pa.Array]:
        pairs = zip(part.column("output").to_pylist(), part.column("form").to_pylist())
        return [pa.array([None if o is None or f is None else restore(o, f, options) for o, f in pairs], pa.string())]

    return _mapped(docs, "restored string", columns, "output")


def round_trip(docs: DataFrame, options: FimOptions = FimOptions()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of each row: transformed, and restored from the output."""

    def columns(part: pa.RecordBatch) -> list[pa.Array]:
        rows = _rows(part, options)
        outputs = [str(x.output) for x in rows]
        back = [restore(o, x.form, options) for o, x in zip(outputs, rows)]
        values = [*zip(*((x.n, x.form, x.prefix_chars, x.middle_chars) for x in rows)), *([hashlib.sha256(t.encode()).hexdigest() for t in texts] for texts in (outputs, back))]
        return [pa.array(v, t) for v, t in zip(values, [*_TYPES, pa.string(), pa.string()])]

    made = _mapped(docs.select("doc_id", "text"), f"{MADE}, output_sha256 string, restored_sha256 string", columns)
    return made.drop("text")
