"""Language by bit-sliced Bloom filters of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import U, Texts, parts, signed, spread, steps

#: Bytes of an n-gram, hashes of an n-gram, and rows of the filters as a power of two.
GRAM, HASHES, BITS = 4, 3, 18
#: Expected sample rows of a language, and n-grams that the filter of a language holds at most.
SAMPLE_ROWS, FILTER_GRAMS = 1500, 20_000
#: A language holds an n-gram if it is found this often, and not much rarer than in another language.
LEAST_COUNT, LEAST_SHARE = 3, 0.2
UNKNOWN = "und"
LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def letter_grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Letter n-grams of all rows, and the row of each. Everything between letters counts as one space."""
    data, n = texts.data, len(texts.data)
    letter = LETTER[data]
    opens = np.zeros(n + 1, bool)
    opens[texts.starts] = True
    before = np.concatenate([[True], letter[:-1]]) if n else letter
    keep = letter | before | opens[:n]
    row = np.repeat(np.arange(texts.rows, dtype=np.int32), np.diff(texts.starts))[keep]
    units = np.where(letter, data, 32)[keep].astype(np.uint32)
    out = np.zeros(max(len(units) - GRAM + 1, 0), np.uint32)
    for i in range(GRAM):
        out = (out << np.uint32(8)) | units[i:i + len(out)]
    own = row[:len(out)] == row[GRAM - 1:]
    return out[own], row[:len(out)][own]


def lowered(column: pa.Array) -> Iterator[Texts]:
    return steps(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))


def cells(grams: np.ndarray) -> list[np.ndarray]:
    """Rows of the filters that an n-gram is looked up in."""
    h = spread(grams.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    return [((h >> U(i * 20)) & U((1 << BITS) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """``rows[cell, word]``: one bit for each language, 64 in a word. ``false``: chance that a filter holds any n-gram."""

    languages: list[str]
    rows: np.ndarray
    false: np.ndarray

    @classmethod
    def build(cls, held: dict[str, np.ndarray], order: list[str]) -> LanguageFilters:
        """``held``: n-grams of each language; ``order``: languages, the one to prefer in a tie first."""
        rows = np.zeros((1 << BITS, max(1, -(-len(order) // 64))), U)
        for i, name in enumerate(order):
            for at in cells(held[name]):
                rows[at, i // 64] |= U(1 << (i % 64))
        full = [((rows[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(order))]
        return cls(order, rows, np.array(full) ** HASHES)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that hold it, all at once."""
        first, *more = cells(grams)
        out = self.rows[first]
        for at in more:
            out &= self.rows[at]
        return out

    def scores(self, texts: Texts) -> np.ndarray:
        """Share of the n-grams of each row that each language holds, less the false positives of its filter."""
        grams, row = letter_grams(texts)
        masks, total = self.masks(grams), np.bincount(row, minlength=texts.rows)
        out = np.zeros((texts.rows, len(self.languages)))
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> U(i % 64)) & U(1)
            out[:, i] = np.bincount(row, bit, minlength=texts.rows) / np.maximum(total, 1)
        return np.maximum(0, (out - self.false) / (1 - self.false + 1e-12)) * (total > 0)[:, None]


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Filters from rows with ``text`` and ``lang``; rows with a null in either are left out.

    About ``sample_rows`` rows of each language are looked at, chosen by a hash of their text. A filter holds at
    most ``FILTER_GRAMS`` n-grams, the most frequent ones.
    """
    rows = train.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilters.build({}, [])
    limit = F.create_map(*(x for name, n in sizes.items() for x in (F.lit(name), F.lit(int(min(1.0, sample_rows / n) * (1 << 31))))))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < limit[F.col("lang")])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            name = batch.column("lang").dictionary_encode()
            index, names = name.indices.to_numpy(), name.dictionary.to_pylist()
            for texts in lowered(batch.column("text")):
                grams, row = letter_grams(texts)
                both = (index[texts.first + row].astype(U) << U(32)) | grams
                found, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in (found >> U(32)).astype(int)], pa.string()), pa.array(signed(found & U(0xFFFFFFFF))), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= LEAST_COUNT).toPandas()
    found["share"] = found["n"] / found.groupby("lang")["n"].transform("sum")
    found = found[found["share"] >= LEAST_SHARE * found.groupby("gram")["share"].transform("max")]
    found = found.sort_values(["n", "gram"], ascending=[False, True]).groupby("lang").head(FILTER_GRAMS)
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    return LanguageFilters.build({x: found["gram"][found["lang"] == x].to_numpy().astype(np.uint32) for x in order}, order)


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1): the language whose filter holds most n-grams, and its part of all shares.

    ``lang_pred`` is ``und`` with score 0 if a text is null or has no letter, or if no language was learned. A text
    none of whose n-grams is known gets the most frequent language with score 0, and so do ties. Only ``text`` is
    looked at; every row stays, repeated ones too, with its other columns; columns named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2 MB for each 64 languages
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = held.value
        for batch in parts(found):
            names, scores = [], []
            for texts in lowered(batch.column("text")):
                shares = filters.scores(texts) if filters.languages else np.zeros((texts.rows, 1))
                best = shares.argmax(axis=1)
                part = shares[np.arange(texts.rows), best] / np.maximum(shares.sum(axis=1), 1e-12)
                latin = np.add.reduceat(np.concatenate([LETTER[texts.data] & (texts.data < 128), [False]]), texts.starts[:-1]) * (np.diff(texts.starts) > 0)
                for i in range(texts.rows):
                    known = bool(filters.languages) and (latin[i] > 0 or any(map(str.isalpha, texts.text(i).decode())))
                    names.append(filters.languages[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(part[i])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(batches, ", ".join([*fields, "lang_pred string", "score double"]))
