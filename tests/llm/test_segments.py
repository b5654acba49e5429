"""Segment-wise ids against those of whole texts, over texts made of what could mislead a cut."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from fieldweave.llm import byte_bpe
from fieldweave.llm.segments import library_encoder

PARTS = ["a", "the", "X", "É", "́", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\0", " \0", "\x85", "\xa0", "　", "​", ".", "'s", "'", "1", "22", "日本", "🙂", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "\x01", "İ", "Σ", "ß", "_", "ﬁ", "Wort", "Éa", "mañana", "word.", "(so)", "$$$", "-", "#", "é", "÷", "×"]


def texts(n=6000):
    draw = random.Random(5)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def whole_library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def whole_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


CASES = {
    "ranks": (lambda: byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), whole_ranks),
    "byte": (lambda: library_encoder(P.path("byte_bpe_50k.json"), spaced=True), lambda: whole_library("byte_bpe_50k.json")),
    "word": (lambda: library_encoder(P.path("word_bpe_49k.json"), spaced=False), lambda: whole_library("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", CASES)
def test_ids_of_segments_are_those_of_the_whole_text(name):
    made, whole = (f() for f in CASES[name])
    given = texts()
    ids, ends = made.batch(given)
    for text, a, b in zip(given, ends, ends[1:]):
        assert list(ids[a:b]) == whole(text), repr(text)
