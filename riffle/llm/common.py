"""Shared parts of the operators: row keys, text buffers, hashes of words and windows.

All hashing is plain numpy over the UTF-8 buffer of an Arrow batch, so that no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.session import materialize

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
U = np.uint64


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``docs`` as (``key`` long, ``doc_id``, ``text``, columns): one key for each row, in the order of ``doc_id``.

    The key is ``doc_id`` itself where that is unique and never null. Otherwise the rows are numbered in the
    order of (``doc_id``, null first; ``text``) and written, so that every later read sees the same numbers. A null
    text is empty. No other column of ``docs`` is looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns)
    twice = docs.groupBy("doc_id").count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if not twice.limit(1).count():
        return rows.withColumn("key", F.col("doc_id").cast("long"))
    ordered = rows.withColumn("_first", F.col("doc_id").isNotNull())
    ordered = ordered.repartitionByRange(F.col("_first"), "doc_id", "text").sortWithinPartitions("_first", "doc_id", "text")
    return materialize(ordered.drop("_first").withColumn("key", F.monotonically_increasing_id()), "keyed")


@dataclass
class Texts:
    """Some rows of a batch: their bytes end to end, and where each row begins (one more entry for the end)."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.starts[row]:self.starts[row + 1]].tobytes()


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[Texts]:
    """The rows of a string column in steps of at most ``most`` bytes, or one row. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield Texts(row, data[starts[row]:starts[end]], starts[row:end + 1] - starts[row])
        row = end


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept for later tasks, and with them what they hold."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def keep_small() -> None:
    """Let the C library reuse freed arrays of up to 4 MB instead of asking the system for fresh pages each time."""
    with suppress(AttributeError, OSError):  # a C library without it
        library = ctypes.CDLL(None)
        library.mallopt(-3, 4 << 20)
        library.mallopt(-1, 16 << 20)


def parts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 * STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices with at most ``most`` bytes of ``column``, or one row.

    Results are handed on slice by slice, so that a task never holds more than that besides the batch it was given.
    """
    for batch in batches:
        if not len(batch):
            yield batch
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, row = np.cumsum(sizes, dtype=np.int64), 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
            yield batch.slice(row, end - row)
            row = end
        give_back()


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits of ``x``."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = U(0x9E3779B97F4A7C15)
BYTES = spread(np.arange(1, 257, dtype=U) * BASE)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        out = np.ones(max(n, STEP_BYTES), U)
        out[1:] = U(base)
        _powers[str(base)] = have = np.multiply.accumulate(out)
    return have[:n]


@dataclass
class Words:
    """Words of some texts: byte ranges, hashes, and for each row the number of its first word."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    starts: np.ndarray


def words(texts: Texts, table: np.ndarray = BYTES, space: np.ndarray = SPACE) -> Words:
    """Words are runs without bytes of ``space`` (space, and tab to carriage return). ``table``: 64-bit values of the bytes."""
    data, n = texts.data, len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(texts.rows + 1, np.int64))
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[texts.starts] = True
    before = np.concatenate([[False], inside[:-1]])
    begin = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    # Each byte is mixed with its place in the word before the sum: unlike in a polynomial modulo 2 ** 64, no pattern of
    # two letters cancels out.
    at = np.arange(n)
    opened = np.zeros(n, np.int64)
    opened[begin] = begin
    place = (at - np.maximum.accumulate(opened)).astype(U)
    total = np.zeros(n + 1, U)
    np.cumsum(spread(table[data] + place * BASE), out=total[1:])
    hashes = spread(total[end] - total[begin] + (end - begin).astype(U))
    return Words(begin, end, hashes, np.searchsorted(begin, texts.starts))


LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    out = left * U(0xD6E8FEB86659FD93) + right * U(0xA0761D6478BD642F)
    return (out ^ (out >> U(32))) * U(0x9FB21C651E98DF25)


def doubled(hashes: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4 .. grams that start at each place, up to ``most``."""
    out, n = {1: hashes}, 1
    while 2 * n <= most:
        h = out[n]
        out[2 * n] = pair(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return out


def grams(by: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hashes of the n-grams from those of :func:`doubled`."""
    sizes = [1 << b for b in range(n.bit_length()) if n >> b & 1][::-1]
    count = len(by[1]) - n + 1
    if count <= 0:
        return by[1][:0]
    out, at = by[sizes[0]][:count], sizes[0]
    for size in sizes[1:]:
        out = pair(out, by[size][at:at + count])
        at += size
    return out


#: Low bits of a hash that give way to its place, and windows that are looked at together.
PLACE, TOGETHER = U((1 << 24) - 1), 1 << 21


def least(hashes: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of each ``span`` hashes in a row, the first of equal ones."""
    low, size = (hashes & ~PLACE) | np.arange(len(hashes), dtype=U), 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(hashes) - span + 1
    return (np.minimum(low[:n], low[span - size:span - size + n]) & PLACE).astype(np.int64)


@dataclass
class Anchors:
    """Windows of some texts by anchor: anchor i holds the windows that start at ``begin[i] .. end[i] - 1``.

    The anchor of a window is its n-gram of the smallest hash, the first of equal ones. Equal windows have equal
    anchors, so a window can only repeat if its anchor does, and there are far fewer anchors than windows.
    """

    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray


def anchors(by: dict[int, np.ndarray], starts: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of all windows that lie in one row. ``starts``: first unit of each row, one more entry for the end."""
    hashes = spread(grams(by, gram))
    n = len(by[1]) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(np.zeros(0, U), none, none, none)
    span = window - gram + 1
    low = np.concatenate([least(hashes[i:i + TOGETHER + span - 1], span) + i for i in range(0, n, TOGETHER)])
    lengths = np.maximum(np.diff(starts) - window + 1, 0)
    own = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[own]
    place = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1 if len(first) else first
    return Anchors(hashes[place[first]], at[first], at[last] + 1, own[first])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each of ``length`` units lies in one of the ranges."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:length]) > 0


def ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true values as (begin, end)."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def places(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    size = end - begin
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)


def list_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Lists of the given sizes from their values end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def list_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and starts (one more entry for the end) of a list column; null is empty."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
