"""License scans by template markup.

A template is wording with two kinds of regions: `[[...]]` may be left out, `{name:2-8}` stands for that
many words of any kind. Each is compiled into an automaton over words, with an edge for each mandatory
word, an edge past each optional region and a chain of free edges for each replaceable one. A text that
has all mandatory words of a template is run through its automaton from each place where it can begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .text_kernel import Words, byte_set, text_bytes, text_slices, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD = byte_set(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))

# Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public licenses, with optional [[...]] and replaceable {...} regions. Each is given in
# full, as its mandatory clauses stand; sentences that only name a license, and openings of texts, have labels of their own.
MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the {name:1-3} to deal in the {name:1-3} without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the {name:1-3} and to permit persons to whom the {name:1-3} is furnished to do
so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]
shall be included in all copies or substantial portions of the {name:1-3} the {name:1-3} is provided as is without warranty of any
kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
noninfringement in no event shall {holder:1-8} be liable for any claim damages or other liability whether in an action of contract
tort or otherwise arising from out of or in connection with the {name:1-3} or the use or other dealings in the {name:1-3}
"""
BSD_CONDITIONS = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following
conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and
the following disclaimer in the documentation and or other materials provided with the distribution
"""
BSD_NAMES = """
[[3]] neither the name of {holder:1-10} nor the names of {possessive:1-2} contributors may be used to endorse or promote products
derived from this software without specific prior written permission
"""
BSD_DISCLAIMER = """
this software is provided by {provider:1-12} as is and any express or implied warranties including but not limited to the implied
warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {liable:1-12} be liable for any
direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods
or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
the possibility of such damage
"""
ISC = """
permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies the software is provided as is and {holder:1-8}
disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
shall {holder:1-8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss
of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
the use or performance of this software
"""
APACHE = """
licensed under the apache license version 2 0 the license you may not use {object:1-3} except in compliance with the license you
may obtain a copy of the license at {scheme:1-1} www apache org licenses license 2 0 unless required by applicable law or agreed to
in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
either express or implied see the license for the specific language governing permissions and limitations under the license
"""
GPL_OPENING = """
{program:1-3} is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either
"""
GPL_WARRANTY = """
of the license or at your option any later version {program:1-3} is distributed in the hope that it will be useful but without any
warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
license for more details
"""
MPL = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
file you can obtain one at {scheme:1-1} mozilla org mpl 2 0
"""
UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights
to this software under copyright law the software is provided as is without warranty of any kind express or implied including but
not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
connection with the software or the use or other dealings in the software
"""
ZLIB = """
this software is provided as is without any express or implied warranty in no event will {holder:1-4} be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must
not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly
marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from
any source distribution
"""

TEMPLATES = (
    ("apache-2.0", APACHE),
    ("bsd-2-clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("bsd-3-clause", BSD_CONDITIONS + BSD_NAMES + BSD_DISCLAIMER),
    ("gpl-2.0-or-later", GPL_OPENING + "version 2" + GPL_WARRANTY),
    ("gpl-3.0-or-later", GPL_OPENING + "version 3" + GPL_WARRANTY),
    ("isc", ISC),
    ("mit", MIT),
    ("mpl-2.0", MPL),
    ("unlicense", UNLICENSE),
    ("zlib", ZLIB),
    ("apache-notice", "licensed under the apache license [[version]] 2 0 [[the license]]"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by [[international]] 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[international]] 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc sa [[international]] 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa [[international]] 4 0"),
    ("copyright-notice", "copyright [[c]] {year:1-3} [[by]] {holder:1-6} all rights reserved"),
    ("gpl-2.0-notice", "[[licensed]] [[distributed]] under the [[terms of the]] [[gnu]] general public license version 2"),
    ("gpl-3.0-notice", "[[licensed]] [[distributed]] under the [[terms of the]] [[gnu]] general public license version 3"),
    ("isc-notice", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-notice", "[[released]] [[licensed]] [[distributed]] under the [[terms of the]] mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-notice", "subject to the terms of the mozilla public license [[v]] [[version]] 2 0"),
    ("unlicense-notice", "this is free and unencumbered software released into the public domain"),
)


def parsed(markup: str) -> list:
    """Words, ("optional", [words]) and ("free", least, most)."""
    out = []
    for optional, least, most, word in re.findall(r"\[\[(.*?)\]\]|\{\w+:(\d+)-(\d+)\}|(\S+)", markup):
        out.append(("optional", optional.split()) if optional else ("free", int(least), int(most)) if least else word)
    return out


def as_regex(markup: str) -> str:
    """The same texts as the automaton accepts, over words with single spaces around them."""
    out = []
    for part in parsed(markup):
        out.append(re.escape(part) + " " if isinstance(part, str) else f"({re.escape(' '.join(part[1]))} )?".replace("\\ ", " ") if part[0] == "optional" else f"([^ ]+ ){{{part[1]},{part[2]}}}")
    return " " + "".join(out)


def sql_labels(text: str, templates=TEMPLATES) -> str:
    """DuckDB expressions for the labels of all templates that a text of spaced words matches."""
    by: dict[str, list[str]] = {}
    for label, markup in templates:
        by.setdefault(label, []).append(as_regex(markup))
    return ", ".join(f"case when regexp_matches({text}, '{'|'.join(x)}') then '{label}' end" for label, x in by.items())


class Automaton:
    """edges[state] has (word or None for any, next state); skips[state] has states that cost no word."""

    def __init__(self, markup: str) -> None:
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.needed: set[str] = set()
        for part in parsed(markup):
            if isinstance(part, str):
                self._step(part)
                self.needed.add(part)
            elif part[0] == "optional":
                begin = len(self.edges) - 1
                for word in part[1]:
                    self._step(word)
                self.skips[begin].append(len(self.edges) - 1)
            else:
                at = []
                for i in range(part[2]):
                    at += [len(self.edges) - 1] if i >= part[1] else []
                    self._step(None)
                for state in at:
                    self.skips[state].append(len(self.edges) - 1)
        self.final = len(self.edges) - 1
        self.begin = self._closed({0})
        self.first = {word for state in self.begin for word, _ in self.edges[state]}

    def _step(self, word: str | None) -> None:
        self.edges[-1].append((word, len(self.edges)))
        self.edges.append([])
        self.skips.append([])

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def match(self, tokens: list[str], at: int) -> int:
        """The end of the longest match that begins at the word `at`, or -1."""
        states, end = self.begin, -1
        while states:
            if self.final in states:
                end = at
            if at == len(tokens):
                break
            states = self._closed({n for s in states for word, n in self.edges[s] if word is None or word == tokens[at]})
            at += 1
        return end


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.templates = [(label, Automaton(markup)) for label, markup in templates]
        vocabulary = sorted({w for _, a in self.templates for w in a.needed} | {w for p in phrases for w in p.split()})
        key = words(pa.array([" ".join(vocabulary)])).hashes()
        order = np.argsort(key)
        self.keys, self.ids = key[order], order
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.needed = [np.array(sorted(self.number[w] for w in a.needed)) for _, a in self.templates]
        self.phrases = [([self.number[w] for w in p.split()], label) for p, label in phrases.items()]

    def known(self, w: Words) -> np.ndarray:
        """The vocabulary's number of each word, or -1."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def scan(self, column: pa.Array) -> dict[str, list | np.ndarray]:
        data = LOWER[text_bytes(column)[0]]
        w = words(column, WORD, data)
        ids = self.known(w)
        n_docs, n_words = w.n_docs, np.diff(w.bounds)
        base: list[set] = [set() for _ in range(n_docs)]
        count, first, last = np.zeros(n_docs, np.int64), np.full(n_docs, -1), np.full(n_docs, -1)
        for phrase, label in self.phrases:
            k = len(phrase)
            hit = np.ones(max(len(ids) - k + 1, 0), bool)
            for i, word in enumerate(phrase):
                hit &= ids[i : len(ids) - k + 1 + i] == word
            at = np.flatnonzero(hit)
            at = at[w.doc[at] == w.doc[at + k - 1]]
            for d, x in zip(w.doc[at].tolist(), (at - w.bounds[w.doc[at]]).tolist()):
                base[d].add(label)
                count[d] += 1
                first[d] = x if first[d] < 0 else min(first[d], x)
                last[d] = max(last[d], x)
        has = np.zeros((n_docs, len(self.number)), bool)
        at = np.flatnonzero(ids >= 0)
        has[w.doc[at], ids[at]] = True
        spans: list[list] = [[] for _ in range(n_docs)]
        tokens: dict[int, list[str]] = {}
        for (label, automaton), needed in zip(self.templates, self.needed):
            for d in np.flatnonzero(has[:, needed].all(axis=1)).tolist():
                if d not in tokens:
                    tokens[d] = [data[a:b].tobytes().decode() for a, b in zip(w.start[w.bounds[d] : w.bounds[d + 1]], w.end[w.bounds[d] : w.bounds[d + 1]])]
                for i, word in enumerate(tokens[d]):
                    if (word in automaton.first or None in automaton.first) and (end := automaton.match(tokens[d], i)) > i:
                        spans[d].append({"label": label, "first": i, "end": end})
        return {"n_words": n_words, "n_base": count, "first_word": first, "last_word": last, "base": base, "spans": spans}


SCANNED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, end: long>>"


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """docs with the license wording found in each text.

    spans has each place that a template accepts; labels has the labels of phrases and templates, sorted,
    joined by commas and empty if there are none. score is 1 if a template accepts a place of the text, 0.5
    if only a phrase stands there, else 0. Null and empty texts have no words and score 0. Rows are scanned
    one by one. Columns of docs with the name of one that is made are replaced.
    """
    made = [x.split()[0] for x in SCANNED.split(", ")[:8]]
    shared.small_batches(docs.sparkSession)
    source = docs.drop(*made)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", " + SCANNED
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for part in text_slices(batch):
                x = scanner.scan(part.column("text"))
                none = x["n_base"] == 0
                accepted = [{s["label"] for s in spans} for spans in x["spans"]]
                columns = [
                    pa.array(x["n_words"]), pa.array(x["n_base"]), pa.array(x["first_word"], mask=none), pa.array(x["last_word"], mask=none), pa.array([",".join(sorted(b)) for b in x["base"]], pa.string()),
                    pa.array([",".join(sorted(b | a)) for b, a in zip(x["base"], accepted)], pa.string()), pa.array([1.0 if a else 0.5 if b else 0.0 for b, a in zip(x["base"], accepted)], pa.float64()), pa.array(x["spans"], span_type),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *made])

    return shared.arrow_map(source, run, schema)
