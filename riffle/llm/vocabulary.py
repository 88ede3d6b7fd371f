"""A public vocabulary of byte pairs with word ends: how it cleans a text and cuts it into words, and its merges."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import SparkSession

END = "</w>"
#: Texts of words that a task remembers; it forgets all of them beyond this.
REMEMBERED = 400_000

# White space, and what Unicode 16 adds to the letters, numbers and capitals of Unicode 15.1.
SPACES = "\t-\r \x85\xa0  -     　"
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}}
# Marks that the composition of the vocabulary's library does not know; it never moves or joins them.
UNKNOWN_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97),
    (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
FIRST_MARK, FIRST_CAPITAL, SIGMA = chr(UNKNOWN_MARKS[0][0]), chr(min(NEW_CAPITALS)), "\u03a3"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def category_class(kind: str, more: list[tuple[int, int]]) -> str:
    """Body of a character class: all code points whose category begins with ``kind``, and ``more``."""
    found: list[list[int]] = []
    for code in range(0x110000):
        if unicodedata.category(chr(code))[0] == kind:
            if found and found[-1][1] == code - 1:
                found[-1][1] = code
            else:
                found.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*found, *more])


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


@dataclass
class Vocabulary:
    """``ids`` of symbols, ``ranks`` of symbol pairs, ``special`` texts that are one symbol each, and the word pattern."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    pattern: str
    names: list[str] = field(default_factory=list)

    @classmethod
    @lru_cache(4)
    def load(cls, path: str) -> Vocabulary:
        """From a vocabulary file of lower-case words with word ends (a BPE model whose suffix is ``</w>``)."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, special = held["model"], {x["content"]: x["id"] for x in held["added_tokens"]}
        if model["end_of_word_suffix"] != END:
            raise ValueError("the vocabulary has no word ends")
        letters, numbers = category_class("L", NEW_LETTERS), category_class("N", NEW_NUMBERS)
        pattern = f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+"
        names = [""] * (max([*model["vocab"].values(), *special.values()]) + 1)
        for name, i in [*model["vocab"].items(), *special.items()]:
            names[i] = name
        return cls(model["vocab"], {tuple(x): i for i, x in enumerate(model["merges"])}, special, pattern, names)

    def shared(self, spark: SparkSession):
        """Sent once to each executor; a vocabulary file has a fixed size of a few MB."""
        return spark.sparkContext.broadcast(self)


class Cutter:
    """Cuts texts into chunks without white space, and chunks into words, for one task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.word = re.compile(vocabulary.pattern)
        self.space = re.compile(f"[{SPACES}]+")
        self.mark = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN_MARKS) + "])")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.names = dict(enumerate(byte_names()))

    def chunks(self, text: str) -> list[str]:
        """The text at white space. A chunk is cleaned by itself: no composition and no word crosses a space."""
        if re.search("[\x1c-\x1f]", text):  # white space to Python only
            return [x for x in self.space.split(text) if x]
        return text.split()

    def parts(self, text: str) -> list[str]:
        """The text around its special texts, those included at odd places."""
        return self.special.split(text) if self.special else [text]

    def words(self, chunk: str) -> list[str]:
        """Words of a chunk, a character for each byte."""
        if chunk.isascii():
            clean = chunk.lower()
        else:
            pieces = self.mark.split(chunk) if max(chunk) >= FIRST_MARK else [chunk]
            clean = "".join(unicodedata.normalize("NFC", x) for x in pieces)
            # Each character by itself: a capital sigma that ends a word is no special case.
            clean = "".join(map(str.lower, clean)) if SIGMA in clean else clean.lower()
            if max(clean) >= FIRST_CAPITAL:
                clean = clean.translate(NEW_CAPITALS)
        # Printable ASCII stands for itself.
        return [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.names) for x in self.word.findall(clean)]
