"""Token counts by byte-pair merging with a heap and a linked list; no ids are made."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import parts
from riffle.llm.vocabulary import END, REMEMBERED, Cutter, Vocabulary


def linked(word: str, ranks: dict[tuple[str, str], int]) -> tuple[list[str | None], int]:
    """Symbols of a word (None where one was merged into its left neighbour), and the number of merges.

    The heap holds (rank, place) of adjacent pairs; the lowest rank, and of equal ones the leftmost, is merged next.
    An entry whose pair has changed since is skipped. Time grows with n log n.
    """
    symbols: list[str | None] = [*word[:-1], word[-1] + END]
    n = len(symbols)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, None
        merges += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (rank, h, symbols[h], symbols[i]))
    return symbols, merges


def merge(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    return [x for x in linked(word, ranks)[0] if x is not None]


class Counted(dict):
    """Numbers of tokens of chunks, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ranks, self.cutter, self.words = vocabulary.ranks, Cutter(vocabulary), {}

    def __missing__(self, chunk: str) -> int:
        total = 0
        for word in self.cutter.words(chunk):
            count = self.words.get(word)
            if count is None:
                count = self.words[word] = len(word) - linked(word, self.ranks)[1]
            total += count
        self[chunk] = total
        return total

    def trim(self) -> None:
        for held in (self, self.words):
            if len(held) > REMEMBERED:
                held.clear()


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``) of every row.

    ``path`` names a vocabulary file of words with word ends; texts of special symbols count as one token each, and
    nothing is added or cut off. A null or empty text has no byte and no token. Repeated rows and rows without
    ``doc_id`` are counted like all others; other columns are ignored. An empty table gives an empty result.
    """
    held = Vocabulary.load(path).shared(docs.sparkSession)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted(held.value)
        for batch in parts(found):
            out = []
            for text in batch.column("text"):
                pieces = counted.cutter.parts(text.as_py() or "")
                out.append(len(pieces) // 2 + sum(sum(map(counted.__getitem__, counted.cutter.chunks(x))) for x in pieces[::2]))
                counted.trim()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(batches, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
