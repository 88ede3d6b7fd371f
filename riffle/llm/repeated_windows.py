"""Removal of repeated word windows: a count-min prefilter, then an exact grouping of what it lets through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import anchors, covered, doubled, grams, keyed, list_slices, pair, parts, places, signed, steps, words
from riffle.llm.repeats import NOTHING, anchor_table, apart, chosen, estimated_repeated, listed

#: Words of an anchor.
GRAM = 8


def remove_repeated(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove each word of a text that lies in a window of ``window`` words found anywhere else too.

    Words are runs without space and tab to carriage return; "anywhere else" includes the same text, and windows
    are judged on the input. Returns (``doc_id``, ``n_words``, ``n_removed``, ``kept_text``) for every input row,
    ``kept_text`` being the kept words joined by one space.

    A null or empty text has no word and keeps nothing; a text shorter than a window keeps all. Rows that share a
    ``doc_id`` (or have none) are different texts, so two equal rows repeat each other. Other columns are ignored.
    An empty table gives an empty result.

    Two windows are equal if their 64-bit hashes and the 64-bit hashes of their anchors are: for different windows
    both would have to collide at once.
    """
    rows, gram = keyed(docs), min(GRAM, window)

    def find(texts):
        found = words(texts)
        return anchors(doubled(found.hash, window), found.starts, window, gram)

    hot = listed(estimated_repeated(anchor_table(rows, find)), "anchor")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            hot, at = list_slices(batch.column("anchor"))
            for texts in steps(batch.column("text")):
                found = words(texts)
                by = doubled(found.hash, window)
                got = chosen(anchors(by, found.starts, window, gram), np.unique(hot[at[texts.first]:at[texts.first + texts.rows]]))
                size = got.end - got.begin
                begin, row, anchor = places(got.begin, got.end), np.repeat(got.row, size), np.repeat(got.hash, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(pair(grams(by, window)[begin], anchor))), pa.array(keys[texts.first + row]),
                     pa.array((begin - found.starts[row]).astype(np.int32))], ["anchor", "hash", "key", "begin"])

    # Only windows that turn out to be alone are sent back: the least key and place of a group of one are its own.
    estimated = rows.select("key", "text").join(hot, "key").mapInArrow(windows, "anchor long, hash long, key long, begin int")
    alone = estimated.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("begin").alias("begin"))
    alone = listed(alone.where("n = 1"), "begin")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in apart(batches):
            hot, at = list_slices(batch.column("anchor"))
            single, single_at = list_slices(batch.column("begin"))
            n_words, n_removed, out = [], [], []
            for texts in steps(batch.column("text")):
                found = words(texts)
                some = np.unique(hot[at[texts.first]:at[texts.first + texts.rows]])
                got = chosen(anchors(doubled(found.hash, window), found.starts, window, gram), some) if len(hot) else NOTHING
                order = np.searchsorted(got.row, np.arange(texts.rows + 1))
                for i in range(texts.rows):
                    row, base = texts.first + i, found.starts[i]
                    n, kept_words = int(found.starts[i + 1] - base), texts.text(i).split()
                    removed = 0
                    if order[i] < order[i + 1]:
                        begin = places(got.begin[order[i]:order[i + 1]], got.end[order[i]:order[i + 1]]) - base
                        begin = np.setdiff1d(begin, single[single_at[row]:single_at[row + 1]], assume_unique=True)
                        gone = covered(n, begin, begin + window)
                        removed = int(gone.sum())
                        if removed:
                            kept_words = [kept_words[j] for j in np.flatnonzero(~gone)]
                    n_words.append(n)
                    n_removed.append(removed)
                    out.append(b" ".join(kept_words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"])

    kind = dict(rows.dtypes)["doc_id"]
    return (rows.join(hot.join(alone, "key", "left"), "key", "left").select("doc_id", "text", "anchor", "begin")
            .mapInArrow(kept, f"doc_id {kind}, n_words long, n_removed long, kept_text string"))
