"""Benchmark passages in documents by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import BYTES, U, Texts, doubled, grams, parts, powers, steps, words

#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark is taken in as many passes.
BLOCK_BYTES = 8 << 20
#: First length that the tiling searches for.
FIRST = 32
#: A token is a run of letters, digits and bytes beyond ASCII.
SEPARATOR = ~np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
BITS = 22
BASE = 0x9E3779B97F4A7C15


def tokens(column: pa.Array) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """For each step of a text column the hashes of all tokens in lower case, and where those of each row begin."""
    for texts in steps(pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))):
        found = words(texts, BYTES, SEPARATOR)
        yield texts, found.hash, found.starts


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens from the running hash of :func:`running`."""
    return sums[size:] - sums[:-size] * U(pow(BASE, size, 1 << 64))


def running(hashes: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, 2 .. tokens: each the one before times the base, plus the token."""
    n = len(hashes)
    back = powers(pow(BASE, -1, 1 << 64), n + 1)
    out = np.zeros(n + 1, U)
    np.cumsum(hashes * back[1:], out=out[1:])
    return out * powers(BASE, n + 1)


def tiled(item: np.ndarray, text: np.ndarray, least: int) -> int:
    """Tokens of ``item`` in tiles: common runs of ``least`` tokens or more that overlap on neither side.

    Tiles are marked longest first. The search length starts high, jumps up when a much longer match turns up, and
    is halved until it is ``least``; at each length a Karp-Rabin pass finds where unmarked windows are equal.
    """
    sums = running(item), running(text)
    free = np.ones(len(item), bool), np.ones(len(text), bool)
    size, total = max(least, min(FIRST, len(item))), 0
    while True:
        found, jump = [], 0
        if size <= min(len(item), len(text)):
            hashes = [window_hashes(s, size) for s in sums]
            whole = [np.convolve(f, np.ones(size, np.int64), "valid") == size for f in free]
            mine: dict[int, list[int]] = {}
            for i in np.flatnonzero(whole[0]).tolist():
                mine.setdefault(int(hashes[0][i]), []).append(i)
            places = np.flatnonzero(whole[1])
            places = places[np.isin(hashes[1][places], np.array(list(mine), U))]
            reached: dict[int, int] = {}  # by diagonal, the end of the last match: a match is found once
            for j in places.tolist():
                for i in mine[int(hashes[1][j])]:
                    if reached.get(j - i, -1) >= j + size:
                        continue
                    most = min(len(item) - i, len(text) - j)
                    same = (item[i:i + most] == text[j:j + most]) & free[0][i:i + most] & free[1][j:j + most]
                    n = most if same.all() else int(same.argmin())
                    if n >= size:
                        reached[j - i] = j + n
                        found.append((n, i, j))
                        jump = max(jump, n)
        if jump > 2 * size:
            size = jump
            continue
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        while found:
            n, i, j = found.pop(0)
            ok = free[0][i:i + n] & free[1][j:j + n]
            if ok.all():
                free[0][i:i + n] = free[1][j:j + n] = False
                total += n
                continue
            edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                if b - a >= size:  # what is left of a match between marked tokens
                    found.append((b - a, i + a, j + a))
            found.sort(key=lambda x: (-x[0], x[1], x[2]))
        if size <= least:
            return total
        size = max(least, size // 2)


class Seeds:
    """Token n-grams of benchmark items, and the items and places that have them."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        self.least, self.ids, self.items = least, [], []
        column = pa.array([x[1] for x in items], pa.string())
        for texts, hashes, starts in tokens(column):
            for i in range(texts.rows):
                if starts[i + 1] > starts[i]:
                    self.ids.append(items[texts.first + i][0])
                    self.items.append(hashes[starts[i]:starts[i + 1]].copy())
        # An item shorter than a seed is a seed itself.
        self.sizes = sorted({min(least, len(x)) for x in self.items})
        self.by_size = {}
        for n in self.sizes:
            held = [(i, grams(doubled(x, n), n)) for i, x in enumerate(self.items) if min(least, len(x)) == n]
            seed = np.concatenate([g for _, g in held])
            item = np.concatenate([np.full(len(g), i) for i, g in held])
            place = np.concatenate([np.arange(len(g)) for _, g in held])
            order = np.argsort(seed, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[(seed >> U(64 - BITS)).astype(np.int64)] = True
            self.by_size[n] = seed[order], item[order], place[order], bits

    def find(self, hashes: np.ndarray, starts: np.ndarray, coverage: float) -> list[tuple[int, int, float]]:
        """(row, item, share of the item in tiles) of the rows that hold ``coverage`` or more of an item."""
        out = []
        for n, (seed, item, place, bits) in self.by_size.items():
            own = grams(doubled(hashes, n), n)
            at = np.flatnonzero(bits[(own >> U(64 - BITS)).astype(np.int64)])
            low, high = np.searchsorted(seed, own[at]), np.searchsorted(seed, own[at], "right")
            row = np.searchsorted(starts, at, "right") - 1
            ok = (low < high) & (at + n <= starts[row + 1])
            low, high, row = low[ok], high[ok], row[ok]
            if not len(row):
                continue
            size = high - low
            hit = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size)
            row = np.repeat(row, size)
            found = np.unique(np.stack([row, item[hit], place[hit]]), axis=1)
            pairs = np.flatnonzero(np.any(found[:2, 1:] != found[:2, :-1], axis=0)) + 1
            for part in np.split(found, pairs, axis=1):
                r, i = int(part[0, 0]), int(part[1, 0])
                whole, reach = self.items[i], np.zeros(len(self.items[i]) + 1, np.int64)
                reach[part[2]] += 1
                reach[np.minimum(part[2] + n, len(whole))] -= 1
                if (np.cumsum(reach[:-1]) > 0).sum() < coverage * len(whole):
                    continue  # tiles only lie where seeds do
                share = tiled(whole, hashes[starts[r]:starts[r + 1]], n) / len(whole)
                if share >= coverage:
                    out.append((r, i, share))
        return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """Adds ``leaks``: (``item_id``, ``coverage``) of each benchmark item that a text holds, the fullest first.

    Tokens are runs of letters and digits in lower case. A text holds an item if tiles of ``least`` tokens or more
    (the whole item, if that is shorter) cover ``coverage`` of its tokens, in any order. Items without a token are
    never held; a null or empty text holds none. Every row stays with its columns, repeated rows too; a column named
    ``leaks`` is replaced. Equal items are reported each; a null ``item_id`` is reported as null. An empty
    benchmark or an empty table gives no leak.

    Documents are never shuffled: the benchmark goes to them, in blocks of at most ``BLOCK_BYTES`` of text.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c != "leaks"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    leak = "struct<item_id: long, coverage: double>"
    if not total:
        return docs.withColumn("leaks", F.array().cast(f"array<{leak}>"))

    def added(seeds, first: bool):
        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = seeds.value
            for batch in parts(found):
                leaks = [[] for _ in range(len(batch))] if first else batch.column("leaks").to_pylist()
                for texts, hashes, starts in tokens(batch.column("text")):
                    for row, item, share in held.find(hashes, starts, coverage):
                        leaks[texts.first + row].append({"item_id": held.ids[item], "coverage": share})
                for x in leaks:
                    x.sort(key=lambda y: (-y["coverage"], y["item_id"] is not None, y["item_id"] or 0))
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(leaks, kind)], [*kept, "leaks"])

        return batches

    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if part or not block:
            seeds = spark.sparkContext.broadcast(Seeds([tuple(x) for x in part], least))
            docs = docs.mapInArrow(added(seeds, "leaks" not in docs.columns), ", ".join([*fields, f"leaks array<{leak}>"]))
    return docs
