"""Text quality from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import LOWER, U, Texts, give_back, parts, spread, steps, words

#: Expected rows of the training sample, its largest size in bytes of text, and words that get a vector of their own.
SAMPLE_ROWS, SAMPLE_BYTES, VOCABULARY = 4_000, 8 << 20, 20_000
#: Bytes of text that are scored together.
SCORE_BYTES = 1 << 18
#: Length of a vector, places of an index vector that are not zero, words to each side that are a word's context.
SIZE, NONZERO, CONTEXT = 64, 4, 2
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.01, 1e-4
#: Shapes of a word: length, case, digit, symbol, exclamation, found before in the text, equal to the word before.
SHAPES = 4 * 4 * 2 ** 5


def index_vectors(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each index vector: a fixed random choice for each 64-bit name."""
    h = spread(names[:, None] + np.arange(1, NONZERO + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
    return (h % U(SIZE)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


@dataclass
class Tokens:
    """Each word of some texts: its hash, its shape, and where each row begins."""

    hash: np.ndarray
    shape: np.ndarray
    starts: np.ndarray


def tokens(texts: Texts) -> Tokens:
    found, data = words(texts, LOWER), texts.data
    n = len(found.hash)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int32)])
        return total[found.end] - total[found.begin]

    codes = np.arange(256)
    upper, lower = count((codes >= 65) & (codes <= 90)), count((codes >= 97) & (codes <= 122))
    first = (data[found.begin] >= 65) & (data[found.begin] <= 90)
    case = np.where(upper + lower == 0, 0, np.where(upper == 0, 1, np.where((lower == 0) & (upper > 1), 3, np.where(first & (upper == 1), 2, 1))))
    row = np.repeat(np.arange(texts.rows), np.diff(found.starts))
    order = np.argsort(found.hash ^ spread(row.astype(U) + U(1)), kind="stable")
    named = found.hash[order], row[order]
    again = np.zeros(n, bool)
    again[order[1:]] = (named[0][1:] == named[0][:-1]) & (named[1][1:] == named[1][:-1])
    same = np.zeros(n, bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (row[1:] == row[:-1])
    shape = np.digitize(found.end - found.begin, [4, 9, 16]) * 4 + case
    for flag in (count((codes >= 48) & (codes <= 57)) > 0, count(np.isin(codes, list(b"#*$%&|<>"))) > 0, count(codes == 33) > 0, again, same):
        shape = shape * 2 + flag
    return Tokens(found.hash, shape, found.starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``values`` between ``starts``."""
    out = np.zeros((len(starts) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=np.float64)
    return out


@dataclass
class QualityModel:
    """Vectors of frequent words (``names`` ascending, the last vector for all others) and of shapes; the network."""

    names: np.ndarray
    word_vectors: np.ndarray
    shape_vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def word_index(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, at, len(self.names))

    def pooled(self, found: Tokens) -> np.ndarray:
        """Mean word vector and mean shape vector of each row, and the logarithm of its words."""
        n = np.diff(found.starts)[:, None]
        pools = [sums(self.word_vectors[self.word_index(found.hash)], found.starts), sums(self.shape_vectors[found.shape], found.starts)]
        return np.hstack([*(x / np.maximum(n, 1) for x in pools), np.log1p(n)])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum(((pooled - self.center) / self.scale) @ w1 + b1, 0) @ w2 + b2

    def scores(self, found: Tokens) -> np.ndarray:
        return sigmoid(self.logits(self.pooled(found)) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def context_vectors(texts: Iterator[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> np.ndarray:
    """Random indexing: a token's vector is its own index vector plus the mean of those of the tokens near it.

    ``texts``: token numbers and row starts of some texts at a time.
    """
    places, signs = index_vectors(names)
    total, near = np.zeros(len(names) * SIZE), np.zeros(len(names))
    for index, starts in texts:
        near += np.bincount(index, minlength=len(names))
        row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        for step in range(1, CONTEXT + 1):
            inside = row[step:] == row[:-step]
            for a, b in ((index[step:][inside], index[:-step][inside]), (index[:-step][inside], index[step:][inside])):
                for k in range(NONZERO):
                    total += np.bincount(a * SIZE + places[b, k], signs[b, k], minlength=len(total))
    own = np.zeros((len(names), SIZE))
    np.add.at(own, (np.arange(len(names))[:, None], places), signs)
    return (own + total.reshape(-1, SIZE) / np.maximum(2 * CONTEXT * near, 1)[:, None]).astype(np.float32)


def train_network(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
    """Two layers, log loss, Adam on all rows at once."""
    draw = np.random.default_rng(seed)
    base = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
    layers = [draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN ** -0.5, HIDDEN) * (len(y) > 0), np.array(np.log(base / (1 - base)))]
    moment, square = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, STEPS + 1 if len(y) else 1):
        w1, b1, w2, b2 = layers
        hidden = np.maximum(x @ w1 + b1, 0)
        error = (sigmoid(hidden @ w2 + b2) - y) / len(y)
        back = np.outer(error, w2) * (hidden > 0)
        slopes = [x.T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum()]
        for i, g in enumerate(slopes):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.999 * square[i] + 0.001 * g * g
            layers[i] = layers[i] - RATE * (moment[i] / (1 - 0.9 ** step)) / (np.sqrt(square[i] / (1 - 0.999 ** step)) + 1e-8)
    return layers


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> QualityModel:
    """A model from the texts of ``docs`` that ``labels`` (``doc_id``, ``quality`` 0 or 1) covers.

    The model is fitted on a bounded sample: about ``sample_rows`` labelled rows, chosen by a hash of their
    ``doc_id``, and fewer if their texts exceed ``SAMPLE_BYTES``. Vectors, network and temperature come from it; a
    fifth of it is kept from the network to set the temperature. Rows without ``doc_id`` or ``quality`` are left
    out, a document with several labels takes their mean. Without labelled rows, every score is 0.5.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    total = named.count()
    part = min(1.0, sample_rows / max(total, 1))
    chosen = None
    for _ in range(2):
        picked = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(part * (1 << 31)))
        # At most about sample_rows rows of two numbers.
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        chosen = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
        size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size <= SAMPLE_BYTES:
            break
        part *= SAMPLE_BYTES / size
    found = chosen.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    held = [tokens(t) for t in steps(found.column("text").cast(pa.large_string()).combine_chunks())] if len(found) else []
    y = found.column("quality").to_numpy().astype(float)
    names, n = np.unique(np.concatenate([np.zeros(0, U), *(x.hash for x in held)]), return_counts=True)
    names = np.sort(names[np.lexsort((names, -n))[:VOCABULARY]])
    model = QualityModel(names, np.zeros((len(names) + 1, SIZE), np.float32), np.zeros((SHAPES, SIZE), np.float32), np.zeros(1), np.ones(1), [])
    model.word_vectors = context_vectors(((model.word_index(x.hash), x.starts) for x in held), np.concatenate([names, [U(1)]]))
    model.shape_vectors = context_vectors(((x.shape, x.starts) for x in held), spread(np.arange(SHAPES, dtype=U) + U(1)))
    x = np.concatenate([np.zeros((0, 2 * SIZE + 1)), *map(model.pooled, held)])
    model.center, model.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    model.layers = train_network(((x - model.center) / model.scale)[~aside], y[~aside], seed)
    if aside.any():
        logits = model.logits(x[aside])
        choices = np.geomspace(0.25, 8, 61)
        losses = [-np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)) for t in choices for p in [np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)]]
        model.temperature = float(choices[int(np.argmin(losses))])
    del found, held, x
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Adds ``quality_score`` (0 to 1, higher: better) to every row; only ``text`` is looked at.

    A null or empty text is scored like a text without words, by what the network makes of its zero vector. Every
    row stays, repeated ones too, with its other columns; a column named like the new one is replaced.
    """
    kept = [c for c in docs.columns if c != "quality_score"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY vectors: 5 MB
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in parts(found):
            out = [model.scores(tokens(texts)) for texts in steps(batch.column("text"), SCORE_BYTES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.concatenate(out) if out else np.zeros(0))], [*kept, "quality_score"])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(batches, ", ".join([*fields, "quality_score double"]))
