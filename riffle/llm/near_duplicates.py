"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import LOWER, U, Texts, doubled, grams, keyed, list_column, pair, parts, signed, spread, steps, words
from riffle.llm.components import components
from riffle.session import materialize, release

#: Half keys of a collection and minhashes in one. A table key is a pair of half keys, one of each collection:
#: HALVES ** 2 tables of 2 * ROWS minhashes each, from 2 * HALVES * ROWS minhashes. Two sets of similarity 0.85 share
#: no table with a probability of about 2 * (1 - 0.85 ** ROWS) ** HALVES, or 0.0003.
HALVES, ROWS = 12, 4
#: Sets that are compared with each other in one task.
BLOCK = 1024


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of each row, end to end, and where each row begins."""
    found = words(texts, LOWER)
    by = doubled(found.hash, size)
    full, out = grams(by, size), []
    for i in range(texts.rows):
        begin, end = found.starts[i], found.starts[i + 1]
        n = end - begin
        if n >= size:
            out.append(np.unique(full[begin:end - size + 1]))
        else:
            out.append(grams(doubled(found.hash[begin:end], int(n)), int(n)) if n else found.hash[:0])
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def half_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of 2 * HALVES half keys for each non-empty set."""
    begin = starts[:-1][np.diff(starts) > 0]
    out = np.zeros((len(begin), 2 * HALVES), U)
    factors = spread(np.arange(1, 2 * HALVES * ROWS + 1, dtype=U)) | U(1)
    for k, factor in enumerate(factors if len(begin) else []):
        least = np.minimum.reduceat(spread_once(hashes * factor), begin)
        out[:, k // ROWS] = pair(out[:, k // ROWS], least)
    return out


def spread_once(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> U(32))


def label_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """Components of texts whose shingle sets have ``100 * intersection >= percent * union``.

    Words are runs without space and tab to carriage return, with A-Z in lower case. The set of a text is its
    distinct ``size``-word shingles; a shorter text has its whole sequence as one. Returns for every input row
    ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` that can be reached) and ``kept`` (the row is
    the first of its component).

    A null or empty text, or one without words, has an empty set, is linked with nothing and is kept. Rows that
    share a ``doc_id`` are different texts, and only the first of them can be kept; a null ``doc_id`` comes before
    all others and gives a null ``component_id``. Other columns are ignored. An empty table gives an empty result.

    Equal sets are one vertex from the start. Vertices that share a table key are first compared with the first one
    of theirs. Where a table key then still holds vertices of several components, all vertices that such keys
    connect are compared in blocks, whole sets against whole sets, so that no link is lost to the order; links, not
    pairs, leave a task. No bucket is capped.
    """
    rows = keyed(docs)
    out, ids = labelled(rows, size, percent), rows.select("key", "doc_id")
    out = out.join(ids, "key").join(ids.select(F.col("key").alias("least"), F.col("doc_id").alias("component_id")), "least")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("key") == F.col("least")).alias("kept"))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`label_near_duplicates` keeps, with the columns of ``docs``. A null text comes back empty."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed(docs, (F.struct(*(F.col(f"`{c}`") for c in more)) if more else F.lit(0)).alias("more"))
    first = labelled(rows, size, percent).where("key = least").select("key")
    kept = rows.join(first, "key", "left_semi")
    return kept.select(*(F.col("more")[c].alias(c) if c in more else F.col(c) for c in docs.columns))


def labelled(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(``key``, ``n_shingles``, ``least``): the smallest key of the component of each row of ``rows`` (``key``, ``text``)."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for texts in steps(batch.column("text")):
                hashes, starts = shingles(texts, size)
                n = np.diff(starts)
                halves = half_keys(hashes, starts)
                same = [hashlib.blake2b(hashes[i:j].tobytes(), digest_size=16).digest() if i < j else None for i, j in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[texts.first:texts.first + texts.rows]), pa.array(n), pa.array(same, pa.binary()),
                     list_column(signed(halves.reshape(-1)), np.where(n > 0, 2 * HALVES, 0))], ["key", "n_shingles", "same", "halves"])

    signed_rows = materialize(rows.select("key", "text").mapInArrow(signatures, "key long, n_shingles long, same binary, halves array<long>"), "signatures")
    groups = signed_rows.where("n_shingles > 0").groupBy("same").agg(F.min("key").alias("first"))
    vertices = signed_rows.where("n_shingles > 0").join(groups, "same").where("key = first").select("key", "halves")
    vertices = materialize(vertices, "vertices")

    # Half keys of one vertex cannot make a shared table key: they go before the pairs are formed.
    halves = vertices.select("key", F.posexplode("halves").alias("at", "half"))
    shared = materialize(halves.groupBy("at", "half").agg(F.count("*").alias("n")).where("n > 1").select("at", "half"), "halves")
    mine = halves.join(shared, ["at", "half"], "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "half")).alias("all"))
    tables = mine.select("key", F.explode(F.filter("all", lambda x: x.at < HALVES)).alias("x"), F.filter("all", lambda x: x.at >= HALVES).alias("ys"))
    tables = tables.select("key", "x", F.explode("ys").alias("y")).select("key", F.xxhash64("x", "y").alias("table"))
    tables = materialize(tables, "tables")
    leads = tables.groupBy("table").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("table", "lead")
    leads = materialize(leads, "leads")
    tables_led = materialize(tables.join(leads, "table"), "led")
    release(tables)
    release(shared)
    release(vertices)

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        inside = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * inside >= percent * (len(a) + len(b) - inside)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep = np.zeros(len(batch), bool)
            left = [(t.first + i, h[s[i]:s[i + 1]]) for t in steps(batch.column("text")) for h, s in [shingles(t, size)] for i in range(t.rows)]
            for t in steps(batch.column("other")):
                h, s = shingles(t, size)
                for i in range(t.rows):
                    keep[t.first + i] = linked(left[t.first + i][1], h[s[i]:s[i + 1]])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    starred = tables_led.where("lead < key").groupBy("key").agg(F.min("lead").alias("lead"))
    texts = rows.select("key", "text")
    # Always a merge join: the pairs grow with the input.
    led = starred.hint("merge").join(texts, "key").select(F.col("key").alias("a"), F.col("lead").alias("b"), "text")
    led = led.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("text").alias("other")), "b")
    links = materialize(led.select("a", "b", "text", "other").mapInArrow(compared, "a long, b long"), "links")
    label = components(links)

    # Keys that hold vertices of several components, and what they connect.
    named = tables_led.join(label, "key", "left").withColumn("least", F.coalesce("least", "key"))
    open_tables = named.groupBy("table").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high")
    open_tables = materialize(open_tables.select("table"), "open")
    open_rows = named.join(open_tables, "table", "left_semi").select("key", "lead", "least").distinct()
    open_rows = materialize(open_rows, "rest")
    release(tables_led)
    union = components(open_rows.select(F.col("key").alias("a"), F.col("lead").alias("b")))
    union = union.withColumnRenamed("least", "union")
    member = materialize(open_rows.select("key", "least").distinct().join(union, "key"), "members")
    sizes = member.groupBy("union").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = member.join(sizes, "union").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    # Block b of a union meets block c in the task (least, greatest); one block alone is task (0, 0).
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "least", F.xxhash64("union", F.least("block", "with"), F.greatest("block", "with")).alias("task"))
    placed = placed.hint("merge").join(texts, "key").repartition("task").sortWithinPartitions("task", "key")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            task = batch.column("task").to_numpy()
            key, least = batch.column("key").to_numpy(), batch.column("least").to_numpy()
            for t in steps(batch.column("text")):
                h, s = shingles(t, size)
                for i in range(t.rows):
                    row = t.first + i
                    if task[row] != last:
                        yield from new_links(held)
                        held, last = [], task[row]
                    held.append((key[row], least[row], h[s[i]:s[i + 1]].copy()))
        yield from new_links(held)

    def new_links(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        key = np.array([x[0] for x in held])
        label = np.unique([x[1] for x in held], return_inverse=True)[1]
        sizes = np.array([len(x[2]) for x in held])
        starts = np.cumsum(sizes) - sizes
        names, ids = np.unique(np.concatenate([x[2] for x in held]), return_inverse=True)
        mark, a, b = np.zeros(len(names), np.int32), [], []
        for i in range(len(held) - 1):
            apart = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
            near = apart[(100 * np.minimum(sizes[apart], sizes[i]) >= percent * np.maximum(sizes[apart], sizes[i]))]
            if not len(near):
                continue
            own = slice(starts[i], starts[i] + sizes[i])
            mark[ids[own]] = 1
            if 2 * len(near) > len(held):
                inside = np.add.reduceat(mark[ids], starts)[near]
            else:
                inside = np.array([mark[ids[starts[j]:starts[j] + sizes[j]]].sum() for j in near])
            mark[ids[own]] = 0
            for j in near[100 * inside >= percent * (sizes[near] + sizes[i] - inside)]:
                if label[j] != label[i]:
                    a.append(key[i])
                    b.append(key[j])
                    label[label == label[j]] = label[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    more = placed.select("task", "key", "least", "text").mapInArrow(rest, "a long, b long")
    label = components(materialize(links.union(more), "all_links"))
    first = groups.join(label, F.col("first") == F.col("key"), "left").select("same", F.coalesce("least", "first").alias("least"))
    first = materialize(first, "first")  # so that the join can split a set that very many rows have
    return signed_rows.select("key", "n_shingles", "same").join(first, "same", "left").withColumn("least", F.coalesce("least", "key"))
