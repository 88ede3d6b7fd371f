"""A run-length index of a block of text segments, and the matching statistics that it streams.

The index keeps the borders of the runs of the Burrows-Wheeler transform: for the byte that opens each run its place
in the text, the place of the suffix sorted before it, and how many bytes the two share. Between two such places both
values follow by counting, so the index is as small as the block is repetitive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes that one 64-bit sort key holds, and bits of each (0: past the end of the segment).
PACK, BITS = 7, 9
#: Places whose matching statistics are computed together.
STREAM = 1 << 18


def packed(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The next :data:`PACK` bytes of each place, cut at the end of its segment."""
    out, left = np.zeros(len(data), np.int64), ends - np.arange(len(data))
    padded = np.concatenate([data, np.zeros(PACK, np.uint8)])
    for i in range(PACK):
        out = (out << BITS) | np.where(left > i, padded[i:i + len(data)].astype(np.int64) + 1, 0)
    return out


def sorted_suffixes(keys: np.ndarray, segment: np.ndarray, ends: np.ndarray, n_segments: int) -> np.ndarray:
    """Places in the order of their suffixes (to the end of the segment; equal ones by segment). Prefix doubling."""
    n = len(keys)
    order = np.argsort(keys)
    at = keys[order]
    new = np.concatenate([[True], at[1:] != at[:-1]])
    rank, slot, h = np.empty(n, np.int64), np.arange(n), PACK
    first = np.maximum.accumulate(np.where(new, slot, 0))
    rank[order] = first
    while True:
        tied = ~new | np.concatenate([~new[1:], [False]])
        slot, first = slot[tied], first[tied]
        if not len(slot):
            return order
        places = order[slot]
        past = places + h >= ends[places]
        then = np.where(past, segment[places], rank[np.minimum(places + h, n - 1)] + n_segments)
        key = first * (n + n_segments + 1) + then
        by = np.argsort(key)
        order[slot], key = places[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, slot, 0))
        rank[order[slot]] = first
        h *= 2


def shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common bytes at the places a and b, ``most`` at most."""
    out, open_, step = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(open_):
        open_ = open_[most[open_] > step]
        x = keys[a[open_] + step] ^ keys[b[open_] + step]
        same = np.where(x == 0, PACK, (PACK * BITS - 1 - np.log2(np.maximum(x, 1).astype(np.float64)).astype(np.int64)) // BITS)
        out[open_] = step + same
        open_, step = open_[x == 0], step + PACK
    return np.minimum(out, most)


@dataclass
class RunIndex:
    """``place`` (ascending): sampled places; ``above``: place of the suffix sorted before, -1 if none; ``length``: shared bytes."""

    size: int
    runs: int
    place: np.ndarray
    above: np.ndarray
    length: np.ndarray

    @classmethod
    def build(cls, data: np.ndarray, lengths: np.ndarray) -> RunIndex:
        """``data``: non-empty segments end to end."""
        segment, last = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths)
        ends = last[segment]
        keys = packed(data, ends)
        order = sorted_suffixes(keys, segment, ends, len(lengths))
        opening = np.zeros(len(data), bool)
        opening[last - lengths] = True
        before = np.where(opening, -1, np.concatenate([[0], data[:-1]]).astype(np.int16))[order]
        border = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0)])
        # A place follows from the next one unless that one opens a run, or is of another segment.
        opens = order[border]
        sampled = np.zeros(len(data), bool)
        sampled[opens[~opening[opens]] - 1] = True
        sampled[last - 1] = True
        at = np.flatnonzero(sampled[order])
        place, above = order[at], order[at - 1]
        length = shared(keys, place, above, np.minimum(ends[place] - place, ends[above] - above))
        none = at == 0
        above, length = np.where(none, -1, above), np.where(none, 0, length)
        by = np.argsort(place)
        return cls(len(data), int(border.sum()), place[by], above[by], length[by])

    def matching_statistics(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first place, lengths, sources): for each place the longest match with the suffix sorted before it."""
        for first in range(0, self.size, STREAM):
            places = np.arange(first, min(first + STREAM, self.size))
            sample = np.searchsorted(self.place, places)
            ahead = self.place[sample] - places
            yield first, self.length[sample] + ahead, np.where(self.above[sample] < 0, -1, self.above[sample] - ahead)

    def first_of_long(self, least: int) -> np.ndarray:
        """For each place the first place with the same ``least`` bytes; itself where no earlier one has them."""
        link = np.arange(self.size)
        for first, lengths, sources in self.matching_statistics():
            long = lengths >= least
            link[first:first + len(lengths)][long] = sources[long]
        linked = np.flatnonzero(link != np.arange(self.size))
        least_place, root = np.arange(self.size), link
        while True:  # each group is one chain of links; follow them in doubling steps to its top
            further = root[root[linked]]
            if np.array_equal(further, root[linked]):
                break
            root[linked] = further
        np.minimum.at(least_place, root[linked], linked)
        return least_place[root]
