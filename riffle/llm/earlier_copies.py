"""Removal of byte strings that occurred before, by run-length indexes of the segments that may repeat."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import BYTES, STEP_BYTES, U, Anchors, Texts, anchors, covered, doubled, keep_small, keyed, list_slices, pair, parts, places, ranges, signed, steps
from riffle.llm.repeats import NOTHING, anchor_table, apart, chosen, estimated_repeated, listed
from riffle.llm.run_index import RunIndex
from riffle.session import materialize

#: Bytes of an anchor; where it has too many segments, of the longer ones that split it. A window closes the list.
GRAMS = (20, 40, 70)
#: Segments of one anchor that one index takes, and bytes of segments in an index.
INDEX_SEGMENTS, INDEX_BYTES = 8_000, 1 << 18
#: Bytes that are hashed together: few enough to stay in the cache of a core.
PIECE = 1 << 16


def found_anchors(texts: Texts, window: int, gram: int) -> Anchors:
    """Anchors of all windows of ``texts``, in overlapping pieces, so that a long text needs no long arrays.

    An anchor whose windows lie in two pieces comes once for each.
    """
    keep_small()
    out = []
    for first in range(0, max(len(texts.data), 1), PIECE):
        end = min(first + PIECE + window - 1, len(texts.data))
        got = anchors(doubled(BYTES[texts.data[first:end]], gram), np.clip(texts.starts, first, end) - first, window, gram)
        out.append(Anchors(got.hash, got.begin + first, got.end + first, got.row))
    return out[0] if len(out) == 1 else Anchors(*(np.concatenate([getattr(x, c) for x in out]) for c in ("hash", "begin", "end", "row")))


def segments_of(texts: Texts, got: Anchors, window: int) -> pa.Array:
    """The bytes that the windows of each anchor cover."""
    size = got.end - got.begin + window - 1
    cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(texts.data[places(got.begin, got.begin + size)])])
    return held.cast(pa.binary())


def remove_earlier(docs: DataFrame, window: int = 100) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string (two or more bytes) that also starts earlier.

    Texts are UTF-8 bytes and matches never cross texts; earlier is a smaller ``doc_id``, or a smaller start in
    the same text. Strings are judged on the input and may overlap. Returns (``doc_id``, ``n_bytes``,
    ``n_removed``, ``n_spans``, ``kept``) for every input row; ``kept`` is binary, as a cut may split a character,
    and ``n_spans`` counts the maximal removed runs.

    A null or empty text has no byte; a text shorter than the window keeps all. A null ``doc_id`` comes before all
    others; rows that share one are taken in the order of their texts. Other columns are ignored. An empty
    table gives an empty result.

    Anchors find the segments that may repeat. Equal segments are one row, with their first place. The segments of
    an anchor meet in one run-length index, whose matching statistics tell which windows occur first. If an anchor
    has more than ``INDEX_SEGMENTS`` different segments, these are cut by the longer anchors in them, step by step
    up to anchors as long as a window, and indexed under those: equal windows have equal anchors of every length.
    A very long text is hashed in pieces.
    Only first windows are sent back: the other windows of a repeated anchor are the ones to remove.
    """
    rows, sizes = keyed(docs), sorted({min(gram, window) for gram in (*GRAMS, window)})

    def found(texts):
        return found_anchors(texts, window, sizes[0])

    hot = listed(estimated_repeated(anchor_table(rows, found)), "anchor")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            hot, at = list_slices(batch.column("anchor"))
            for texts in steps(batch.column("text")):
                got = chosen(found(texts), np.unique(hot[at[texts.first]:at[texts.first + texts.rows]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(got.hash)), segments_of(texts, got, window), pa.array(keys[texts.first + got.row]), pa.array(got.begin - texts.starts[got.row])],
                    ["anchor", "segment", "key", "begin"])

    def order(key: str, begin: str):
        return (F.col(key).cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(begin)).alias("order")

    def place(order: str) -> list:
        key = F.floor(F.col(order) / F.lit(1 << 32).cast("decimal(10,0)"))
        return [key.cast("long").alias("key"), F.pmod(F.col(order), F.lit(1 << 32).cast("decimal(10,0)")).cast("long").alias("begin")]

    def longer(gram: int):
        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(found, "segment", STEP_BYTES):
                old, keys, at = (batch.column(c).to_numpy() for c in ("anchor", "key", "begin"))
                for texts in steps(batch.column("segment")):
                    got = found_anchors(texts, window, gram)
                    row = texts.first + got.row
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(pair(old[row].view(U), got.hash))), segments_of(texts, got, window), pa.array(keys[row]),
                         pa.array(at[row] + got.begin - texts.starts[got.row])], ["anchor", "segment", "key", "begin"])

        return batches

    def distinct(cut: DataFrame) -> DataFrame:
        """Equal segments of an anchor as one, at their first place."""
        cut = cut.select("anchor", "segment", order("key", "begin")).groupBy("anchor", "segment").agg(F.min("order").alias("order"))
        return materialize(cut.select("anchor", "segment", *place("order")), "segments")

    kind = "anchor long, segment binary, key long, begin long"
    left = distinct(rows.select("key", "text").join(hot, "key").mapInArrow(segments, kind))
    cut = []
    for gram in sizes[1:]:
        many = left.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > INDEX_SEGMENTS).select("anchor")
        many = materialize(many, "many")
        if not many.limit(1).count():
            break
        cut.append(left.join(many, "anchor", "left_anti"))
        left = distinct(left.join(many, "anchor", "left_semi").mapInArrow(longer(gram), kind))
    cut = reduce(DataFrame.union, cut, left)

    def first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = ["key", "begin", "size"]

        keep_small()

        def first_of(table: pa.Table) -> pa.RecordBatch:
            held = table.column("segment").combine_chunks().cast(pa.large_binary())
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            starts = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
            data, lengths = np.frombuffer(held.buffers()[2], np.uint8)[starts[0]:starts[-1]], np.diff(starts)
            index = RunIndex.build(data, lengths)
            opens = starts[:-1] - starts[0]
            first = index.first_of_long(window) == np.arange(len(data))
            valid = places(opens, opens + lengths - window + 1)
            flags = np.zeros(len(data) + 1, bool)
            flags[valid] = first[valid]  # a segment ends with window - 1 places that open no window
            begin, end = ranges(flags)
            own = np.searchsorted(opens, begin, "right") - 1
            keys, at = (table.column(c).to_numpy()[own] for c in ("key", "begin"))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at + begin - opens[own]), pa.array(end - begin)], kind)

        held, size, rest = [], 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            anchor = table.column("anchor").to_numpy()
            border = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]) if len(anchor) else np.zeros(1, np.int64)
            rest, table = table.slice(border[-1]), table.slice(0, border[-1])  # the last anchor may go on
            for part, alone in split(table, border):
                if alone:
                    yield part
                else:
                    held.append(part)
                    size += part.column("segment").nbytes
            if size >= INDEX_BYTES:
                yield first_of(pa.concat_tables(held))
                held, size = [], 0
        if rest is not None and len(rest):
            for part, alone in split(rest, np.array([0, len(rest)])):
                if alone:
                    yield part
                else:
                    held.append(part)
        if held:
            yield first_of(pa.concat_tables(held))

    def split(table: pa.Table, border: np.ndarray) -> Iterator[tuple]:
        """Finished windows of anchors with one segment, which cannot repeat in it; and the segments of the others."""
        if not len(table):
            return
        count = np.repeat(np.diff(border), np.diff(border))
        one = table.filter(pa.array(count == 1))
        if len(one):
            sizes = pc.binary_length(one.column("segment")).to_numpy().astype(np.int64) - window + 1
            yield pa.RecordBatch.from_arrays([one.column("key").combine_chunks(), one.column("begin").combine_chunks(), pa.array(sizes)], ["key", "begin", "size"]), True
        if len(one) < len(table):
            yield table.filter(pa.array(count > 1)), False

    indexed = cut.repartition("anchor").sortWithinPartitions("anchor", "key", "begin")
    first = indexed.mapInArrow(first_windows, "key long, begin long, size long")

    first = listed(first.select("key", F.shiftleft("begin", 32).bitwiseOR(F.col("size")).alias("first")), "first")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in apart(batches):
            hot, at = list_slices(batch.column("anchor"))
            kept, kept_at = list_slices(batch.column("first"))
            sizes, out = [], []
            for texts in steps(batch.column("text")):
                got = chosen(found(texts), np.unique(hot[at[texts.first]:at[texts.first + texts.rows]])) if len(hot) else NOTHING
                by_row = np.searchsorted(got.row, np.arange(texts.rows + 1))
                for i in range(texts.rows):
                    row, base, text = texts.first + i, texts.starts[i], texts.data[texts.starts[i]:texts.starts[i + 1]]
                    removed = spans = 0
                    if by_row[i] < by_row[i + 1]:
                        mine = slice(by_row[i], by_row[i + 1])
                        own = kept[kept_at[row]:kept_at[row + 1]]
                        repeat = covered(len(text), got.begin[mine] - base, got.end[mine] - base)
                        repeat &= ~covered(len(text), own >> 32, (own >> 32) + (own & 0xFFFFFFFF))
                        begin = np.flatnonzero(repeat)
                        gone = covered(len(text), begin, begin + window)
                        removed, spans = int(gone.sum()), len(ranges(gone)[0])
                        text = text[~gone]
                    sizes.append((len(text) + removed, removed, spans))
                    out.append(text.tobytes())
            n = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2]), pa.array(out, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(rows.dtypes)["doc_id"]
    return (rows.join(hot.join(first, "key", "left"), "key", "left").select("doc_id", "text", "anchor", "first")
            .mapInArrow(kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
