"""Windows that may repeat: a count-min sketch over their anchors, kept as a table.

Used by the two operators that remove repeated passages. Shuffled are anchors (one for about every ``span / 2``
windows), never whole windows, until the sketch has ruled out most of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import Anchors, Texts, parts, signed, steps
from riffle.session import materialize, release

#: Cells of a sketch row for each anchor, and the rows of the sketch.
CELLS_PER_ANCHOR, SKETCH_ROWS = 8, 2


def anchor_table(rows: DataFrame, find: Callable[[Texts], Anchors]) -> DataFrame:
    """(``anchor``, ``key``) for each anchor of each text of ``rows`` (``key``, ``text``)."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(found):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for texts in steps(batch.column("text")):
                got = find(texts)
                yield pa.RecordBatch.from_arrays([pa.array(signed(got.hash)), pa.array(keys[texts.first + got.row])], ["anchor", "key"])

    return rows.select("key", "text").mapInArrow(batches, "anchor long, key long")


def estimated_repeated(table: DataFrame) -> DataFrame:
    """The rows of an anchor table whose estimated count is two or more; none with a true count of two is lost.

    Each task sums its own anchors by cell (a sketch of its partition), the shuffle merges these sketches, and the
    estimate of an anchor is the least of its cells. The second row of the sketch only counts what the first has
    left, which can only lower an estimate, never below the true count. The width follows the number of anchors,
    so a sketch of any input is as sparse, and each of its cells lives in the partition it hashes to. Its repeated
    cells are written, so that the join can split the rows of a cell that is very frequent.
    """
    left = materialize(table, "anchors")
    width = 1 << max(16, (CELLS_PER_ANCHOR * left.count()).bit_length())
    for row in range(SKETCH_ROWS):
        celled = left.withColumn("cell", F.xxhash64("anchor", F.lit(row)).bitwiseAND(F.lit(width - 1)))
        sketch = materialize(celled.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "sketch")
        fewer = materialize(celled.join(sketch, "cell", "left_semi").drop("cell"), "estimated")
        release(left)
        release(sketch)
        left = fewer
    return left


def listed(table: DataFrame, value: str) -> DataFrame:
    """One list of distinct values for each key: as long as one text has anchors or windows, not more."""
    return table.groupBy("key").agg(F.collect_set(value).alias(value))


def chosen(found: Anchors, hot: np.ndarray) -> Anchors:
    """The anchors whose hash is among ``hot``."""
    keep = np.isin(signed(found.hash), hot)
    return Anchors(found.hash[keep], found.begin[keep], found.end[keep], found.row[keep])


def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of joined batches with anchors that may repeat, then those without: these need no hashing."""
    for batch in parts(batches):
        some = batch.column("anchor").is_valid()
        yield batch.filter(some)
        yield batch.filter(pc.invert(some))


NOTHING = Anchors(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
