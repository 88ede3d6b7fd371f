"""Byte-pair encoding with a contiguous array of ranks, and decoding."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import parts
from riffle.llm.heap_merges import merge as merge_long
from riffle.llm.vocabulary import END, REMEMBERED, Cutter, Vocabulary

#: Symbols up to which a word is short: each merge scans its whole array.
SHORT = 128
NONE = sys.maxsize


def merge_short(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of a word: its parts between the boundaries and the rank of each adjacent pair, in two arrays side by side.

    The least rank (the first of equal ones) is looked for again and again; its inner boundary goes, and the ranks
    of the pairs to both sides are looked up anew.
    """
    symbols, get = [*word[:-1], word[-1] + END], ranks.get
    held = [get(pair, NONE) for pair in zip(symbols, symbols[1:])]
    while held:
        low = min(held)
        if low == NONE:
            break
        i = held.index(low)
        symbols[i] += symbols.pop(i + 1)
        del held[i]
        if i < len(held):
            held[i] = get((symbols[i], symbols[i + 1]), NONE)
        if i:
            held[i - 1] = get((symbols[i - 1], symbols[i]), NONE)
    return symbols


class Encoded(dict):
    """Ids of chunks as bytes, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.cutter, self.words = vocabulary, Cutter(vocabulary), {}

    def __missing__(self, chunk: str) -> bytes:
        out = []
        for word in self.cutter.words(chunk):
            ids = self.words.get(word)
            if ids is None:
                symbols = merge_short(word, self.vocabulary.ranks) if len(word) <= SHORT else merge_long(word, self.vocabulary.ranks)
                ids = self.words[word] = [self.vocabulary.ids[x] for x in symbols]
            out += ids
        self[chunk] = found = pack(f"<{len(out)}I", *out)
        return found

    def trim(self) -> None:
        for held in (self, self.words):
            if len(held) > REMEMBERED:
                held.clear()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit integers) of each ``text``.

    ``path`` names a vocabulary file of words with word ends. A text is composed (NFC) and put in lower case, white
    space only separates, and texts of special symbols inside it become these symbols. Nothing is added or cut off.
    A null or empty text has no ids. Every row is kept, repeated ones too, with its other columns; columns named
    like the new ones are replaced. An empty table gives an empty result.

    Words of more than ``SHORT`` bytes are merged with a heap, as scanning an array takes a time that grows with
    the square of its length; both give the same symbols.
    """
    held = Vocabulary.load(path).shared(docs.sparkSession)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        encoded = Encoded(vocabulary)
        special = {x: np.array([i], "<u4").tobytes() for x, i in vocabulary.special.items()}
        for batch in parts(found):
            out = []
            for text in batch.column("text"):
                pieces = encoded.cutter.parts(text.as_py() or "")
                out.append(b"".join(special[x] if i % 2 else b"".join(map(encoded.__getitem__, encoded.cutter.chunks(x))) for i, x in enumerate(pieces)))
                encoded.trim()
            counts = pa.array([len(x) // 4 for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), counts, pa.array(out, pa.binary())], [*kept, "n_tokens", "ids"])

    kept = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(batches, ", ".join([*fields, "n_tokens long", "ids binary"]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the symbols of ``ids`` joined by one space, as this vocabulary has no decoder of its own.

    Special symbols are kept. Null or no ids give an empty text. Other columns stay, one named ``decoded`` is replaced.
    """
    held = Vocabulary.load(path).shared(encoded.sparkSession)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value.names
        for batch in parts(found, "ids"):
            out = [" ".join(map(names.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.string())], [*kept, "decoded"])

    kept = [c for c in encoded.columns if c != "decoded"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in kept]
    return encoded.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(batches, ", ".join([*fields, "decoded string"]))
