"""Alignment of the tokens of two tokenizers by the byte places where tokens of both end."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riffle.llm.common import list_column, list_slices, parts
from riffle.llm.vocabulary import byte_names
from riffle.session import materialize

#: Tokens of the first tokenizer that are aligned together, and links of a group that are written one by one.
TOGETHER, ONE_BY_ONE = 1 << 16, 1 << 12
SPACE_MARK = "▁"


@dataclass
class Tokenizers:
    """What two tokenizers need, as plain values that can be sent to the executors; a few MB.

    ``ranks``: ids of the byte strings of the first one (byte-level pairs, merged in the order of the ids), ``pattern``:
    what it takes for a word; ``pieces``: the model file of the second one.
    """

    ranks: dict[bytes, int]
    pattern: str
    pieces: bytes

    @classmethod
    def load(cls, first: str, pattern: str, second: str) -> Tokenizers:
        with open(first, encoding="utf-8") as file:
            held = json.load(file)
        value = {name: b for b, name in enumerate(byte_names())}
        special = {x["content"] for x in held["added_tokens"]}
        ranks = {bytes(value[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        merges = [held["model"]["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in held["model"]["merges"]]
        if merges != sorted(merges):
            raise ValueError("the ids of the vocabulary do not follow the order of its merges")
        with open(second, "rb") as file:
            return cls(ranks, pattern, file.read())


class Aligner:
    """Both tokenizers in a task. ``tokens`` gives both ids lists, ``cuts`` where groups end in them, ``written`` their text."""

    def __init__(self, held: Tokenizers) -> None:
        first = tiktoken.Encoding("first", pat_str=held.pattern, mergeable_ranks=held.ranks, special_tokens={})
        second = sentencepiece.SentencePieceProcessor(model_proto=held.pieces)
        self.encode_a, self.encode_b = first.encode_ordinary, second.encode
        self.bytes_a = [b""] * (max(held.ranks.values()) + 1)
        for token, i in held.ranks.items():
            self.bytes_a[i] = token
        names = [second.id_to_piece(i) for i in range(second.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if second.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.lengths_a, self.lengths_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        # Each id as the last of its group and as another one; those of the second tokenizer follow.
        self.names = [f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(size) for mark in marks]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both for a space and the text; none if it is null or empty, or if the bytes of either are other ones."""
        if not text:
            return [], []
        a, b, raw = self.encode_a(" " + text), self.encode_b(text), (" " + text).encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
        return (a, b) if same else ([], [])

    def cuts(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the groups in both lists, from 0 on: between two of them both have the same bytes.

        The ends of each side are keys of a dictionary that leads to the index behind the token; the keys that both
        have, in their order, are the cuts. Long lists are taken piece by piece, each up to its last common end.
        """
        i = j = at = 0
        most, cut_a, cut_b = TOGETHER, [0], [0]
        while i < len(a):
            ends_a = dict(zip(accumulate(map(self.lengths_a.__getitem__, a[i:i + most]), initial=at), range(i, i + most + 1)))
            ends_b = dict(zip(accumulate(map(self.lengths_b.__getitem__, b[j:j + 2 * most]), initial=at), range(j, j + 2 * most + 1)))
            common = sorted(ends_a.keys() & ends_b.keys())
            if len(common) == 1:  # at the end of the lists both have one
                most *= 2
                continue
            cut_a += map(ends_a.__getitem__, common[1:])
            cut_b += map(ends_b.__getitem__, common[1:])
            i, j, at, most = cut_a[-1], cut_b[-1], common[-1], TOGETHER
        return np.array(cut_a), np.array(cut_b)

    def written(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``: each token goes behind those of the other side in groups before (or in its own)."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a[1:] - 1] = last_b[cut_b[1:] - 1] = 1
        names = np.empty(len(a) + len(b), np.int64)
        names[np.arange(len(a)) + np.repeat(cut_b[:-1], np.diff(cut_a))] = 2 * a + last_a
        names[np.arange(len(b)) + np.repeat(cut_a[1:], np.diff(cut_b))] = 2 * (b + len(self.bytes_a)) + last_b
        return "".join(map(self.names.__getitem__, names.tolist()))[:-1]


def align(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """(``doc_id``, ``a``, ``b``, ``cut_a``, ``cut_b``) of every row: both ids lists, and where each group ends in them.

    A text is preceded by a space. Null and empty texts, and texts whose tokens of either side do not join to their bytes,
    have empty lists. Repeated rows are aligned alike, other columns are ignored, an empty table gives an empty result.
    A very long text is aligned piece by piece; its ids are lists in memory.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(held.value)
        for batch in parts(found):
            out = []
            for text in batch.column("text"):
                a, b = aligner.tokens(text.as_py())
                cut_a, cut_b = aligner.cuts(a, b)
                out.append((a, b, cut_a[1:], cut_b[1:]))
            lists = [pa.array([x[c] for x in out], pa.list_(pa.int32())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "a", "b", "cut_a", "cut_b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, a array<int>, b array<int>, cut_a array<int>, cut_b array<int>")


def links_of(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different linked id pairs (first id in the upper half) and how often each is linked.

    All tokens of a group are linked with each other. A large group is expanded over its different ids.
    """
    size_a, size_b = np.diff(cut_a), np.diff(cut_b)
    large = size_a * size_b > ONE_BY_ONE
    several: Counter[int] = Counter()
    for i, k, j, n in zip(cut_a[:-1][large], cut_a[1:][large], cut_b[:-1][large], cut_b[1:][large]):
        of_b = Counter(b[j:n].tolist()).items()
        for x, times in Counter(a[i:k].tolist()).items():
            for y, more in of_b:
                several[x << 32 | y] += times * more
    of_a, of_b, wide = cut_a[:-1][~large], cut_b[:-1][~large], size_b[~large]
    links = size_a[~large] * wide
    group = np.repeat(np.arange(len(links)), links)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    down, across = np.divmod(inside, wide[group])
    pairs, times = np.unique(a[of_a[group] + down] << 32 | b[of_b[group] + across], return_counts=True)
    if several:
        every, at = np.unique(np.concatenate([pairs, np.fromiter(several.keys(), np.int64)]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate([times, np.fromiter(several.values(), np.int64)]))
        return every, total
    return pairs, times


def squeeze(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<i8").tobytes() if len(values) and values.max() >= 1 << 31 else values.astype("<i4").tobytes(), "zstd", asbytes=True)


def unsqueeze(held: bytes, n: int) -> np.ndarray:
    for kind in ("<i4", "<i8"):
        with np.errstate(all="ignore"):
            try:
                return np.frombuffer(pa.decompress(held, n * int(kind[2]), "zstd", asbytes=True), kind)
            except OSError:
                continue
    raise ValueError("a block of another length")


def count_links(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Sizes of the alignment of every row, and how its links compare with those of all rows.

    ``n_a``, ``n_b``: tokens; ``n_groups``: groups of :func:`align`; ``n_links``: pairs of token occurrences in a group;
    the count of an id pair is the number of rows that link it; ``n_best``: links whose count is the highest of their
    first id (ties included); ``count_sum``: counts added up over the links; ``groups_sha256``: of the groups in text
    form (``a1,a2|b1;a3|b2,b3``), empty without tokens.

    Rows are aligned once, in blocks of up to 4 MB of text. A block lists its different pairs once, whatever the number of
    rows that hold them, and only these lists meet the counts of all rows; the rows of a block keep places in its list.
    Null, odd, repeated and very long texts and empty tables are as in :func:`align`; each repeated row counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizers)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    kind = docs.schema["doc_id"].dataType
    of_pairs = ["pairs", "docs"]
    shape = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("doc_id", T.ArrayType(kind)), *(T.StructField(c, T.ArrayType(T.LongType())) for c in [*numbers, "n_pairs"]),
        T.StructField("sha", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.LongType())) for c in of_pairs),
        T.StructField("steps", T.BinaryType()), T.StructField("times", T.BinaryType())])

    def blocks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = Aligner(held.value), TaskContext.get().partitionId()
        for number, batch in enumerate(x for x in parts(found) if len(x)):
            rows, shas, pairs, times = [], [], [], []
            for text in batch.column("text"):
                lists = aligner.tokens(text.as_py())
                cuts = aligner.cuts(*lists)
                a, b = (np.array(x, np.int64) for x in lists)
                mine, often = links_of(a, b, *cuts)
                rows.append((len(a), len(b), len(cuts[0]) - 1, int(often.sum()), len(mine)))
                shas.append(sha256(aligner.written(a, b, *cuts).encode()).hexdigest() if len(a) else "")
                pairs.append(mine)
                times.append(often)
            every = np.concatenate(pairs)
            unique, at, docs_of = np.unique(every, return_inverse=True, return_counts=True)
            # Within a row places grow; the first step of a row leads from 0.
            steps, starts = np.diff(at, prepend=0), np.cumsum([0, *map(len, pairs)])[:-1]
            opening = starts[starts < len(at)]
            steps[opening] = at[opening]
            row_list = lambda x, kind: pa.array([x], pa.list_(kind))
            ids = pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | number]), ids, *(row_list([r[i] for r in rows], pa.int64()) for i in range(5)), row_list(shas, pa.string()),
                 list_column(unique, [len(unique)]), list_column(docs_of.astype(np.int64), [len(unique)]),
                 pa.array([squeeze(steps)], pa.binary()), pa.array([squeeze(np.concatenate(times))], pa.binary())], shape.names)

    table = materialize(docs.select("doc_id", "text").mapInArrow(blocks, shape), "alignments")
    listed = table.select("block", F.posexplode(F.arrays_zip(*of_pairs)).alias("at", "x")).select("block", "at", "x.pairs", "x.docs")
    counts = listed.groupBy("pairs").agg(F.sum("docs").alias("n"))
    # As many rows of one first id as the second tokenizer has ids.
    best = F.max("n").over(Window.partitionBy(F.shiftright("pairs", 32)))
    counts = materialize(counts.select("pairs", (2 * F.col("n") + (F.col("n") == best).cast("int")).alias("count")), "counts")
    back = listed.select("block", "at", "pairs").join(counts, "pairs").groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("back"))
    rows = table.select("block", "doc_id", *numbers, "n_pairs", "sha", "steps", "times").join(back, "block", "left")

    def counted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                size = list_slices(one.column("n_pairs"))[0]
                total, ends = int(size.sum()), np.cumsum(size)
                values = one.column("back").flatten()
                count = np.zeros(len(values), np.int64)
                if len(values):
                    count[values.field("at").to_numpy()] = values.field("count").to_numpy()
                steps, times = (unsqueeze(one.column(c)[0].as_py(), total).astype(np.int64) for c in ("steps", "times"))
                # Places are sums of the steps since the row began.
                run = np.concatenate([[0], np.cumsum(steps)])
                at = run[1:] - np.repeat(run[ends - size], size)
                of_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
                found_at = count[at] if total else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [one.column("doc_id").flatten(), *(one.column(c).flatten() for c in numbers), pa.array(of_row(times * (found_at & 1))),
                     pa.array(of_row(times * (found_at >> 1))), one.column("sha").flatten()], out)

    out = ["doc_id", *numbers, "n_best", "count_sum", "groups_sha256"]
    fields = [T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in out[1:-1]), T.StructField("groups_sha256", T.StringType())]
    return rows.mapInArrow(counted, T.StructType(fields))
