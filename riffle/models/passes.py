"""One pass over the observations for many curves of each configuration.

Spark deals the observations and adds up; a task only sums, with NumPy, what a stretch of them says of each interval of
each curve. Curves of the same borders share the place of an observation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.operators.joins import lookup
from riffle.session import materialize

# Observations that a task handles at once.
BLOCK = 65_536


def indexed(frame: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Configurations (keys, ``config``), and their points: ``config``, ``x``, ``y`` and the number of equal observations ``w``.

    Points of a configuration lie together in each file. Keys may be missing.
    """
    found = frame.select(*keys).distinct()
    configs = materialize(found.withColumn("config", F.monotonically_increasing_id()), "configs")
    points = lookup(frame.select(*keys, "x", "y"), configs, keys, configs.count()).groupBy("config", "x", "y").agg(F.count("*").cast("double").alias("w"))
    return configs, materialize(points.sortWithinPartitions("config", "x"), "points")


def powers_of(u: np.ndarray) -> list[np.ndarray | None]:
    """u to the powers 0 to 6; the first is left out, as it changes nothing."""
    u2 = u * u
    u3 = u2 * u
    return [None, u, u2, u3, u2 * u2, u2 * u3, u3 * u3]


def moments(at: np.ndarray, size: int, weight: np.ndarray, powers: Sequence[np.ndarray | None]) -> np.ndarray:
    """Sums of weight times each power in each interval."""
    return np.stack([np.bincount(at, weight if p is None else weight * p, size) for p in powers])


def value(pieces: np.ndarray, at: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The curve at u of the interval."""
    c0, c1, c2, c3 = (c[at] for c in pieces.reshape(-1, 4).T.copy())
    return c0 + u * (c1 + u * (c2 + u * c3))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(configuration, columns) of stretches of a task's rows that belong to one configuration."""
    held, rows = [], 0

    def cut():
        config, *columns = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        ends = [0, *(np.flatnonzero(np.diff(config)) + 1).tolist(), len(config)]
        for a, b in zip(ends, ends[1:]):
            yield int(config[a]), [c[a:b] for c in columns]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield from cut()
            held, rows = [], 0
    if rows:
        yield from cut()


def sums_per_interval(
    points: DataFrame, models: DataFrame, ids: Sequence[str], work: Callable, sums: Mapping[str, int], collect: Sequence[str] = ()
) -> DataFrame:
    """Sums of ``work`` for each curve (``config`` and ``ids``) and ``interval``; only intervals that have points.

    ``points`` has ``config``, ``x`` and the columns of ``work``. ``models`` is a counted, small table of curves, one row each, with ``breaks`` and
    whatever else ``work(model, at, powers, *columns)`` reads: the intervals of the points and the powers of their place in it. It returns
    an array of ``sums[name]`` numbers for each interval under each name, and if ``collect`` names columns, also the points to be kept under
    ``taken``: their intervals and those columns. They come back as an array of structs.
    """
    known = defaultdict(list)
    for row in models.collect():
        model = {k: np.asarray(v, dtype=float) if isinstance(v, list) else v for k, v in row.asDict().items()}
        known[model["config"]].append(model)
    known = dict(known)
    names = [(name, i) for name, count in sums.items() for i in range(count)]
    fields = [models.schema[c] for c in ["config", *ids]]
    struct = "array<struct<" + ", ".join(f"{c}: double" for c in collect) + ">>"
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "interval int", *(f"{n}_{i} double" for n, i in names), *([f"taken {struct}"] if collect else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for config, (x, *columns) in _stretches(batches):
            places, found = {}, []
            for model in known.get(config, ()):
                breaks = model["breaks"]
                key = breaks.tobytes()
                if key not in places:
                    at = np.searchsorted(breaks[1:-1], x, "right")
                    places[key] = at, powers_of((x - breaks[at]) / np.diff(breaks)[at]), np.flatnonzero(np.bincount(at, minlength=len(breaks) - 1))
                at, powers, used = places[key]
                with np.errstate(all="ignore"):  # a curve that leaves all bounds is found when it is solved
                    found.append((model, used, work(model, at, powers, *columns)))
            if found:
                yield _batch(found)

    def _batch(found: list) -> pa.RecordBatch:
        size = [len(used) for _, used, _ in found]
        arrays = [pa.array([model[c] for (model, _, _), n in zip(found, size) for _ in range(n)]) for c in ["config", *ids]]
        arrays.append(pa.array(np.concatenate([used for _, used, _ in found]).astype(np.int32)))
        for name, i in names:
            arrays.append(pa.array(np.concatenate([np.atleast_2d(got[name])[i][used].astype(float) for _, used, got in found])))
        if collect:
            counts, parts = [], []
            for _, used, got in found:
                at, *kept = got["taken"]
                order = np.argsort(at, kind="stable")
                counts.append(np.bincount(at, minlength=used[-1] + 1)[used])
                parts.append([c[order] for c in kept])
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(float)) for c in zip(*parts)], list(collect))
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), held))
        table = pa.RecordBatch.from_arrays(arrays, [f.name for f in fields] + ["interval"] + [f"{n}_{i}" for n, i in names] + (["taken"] if collect else []))
        return table.cast(_arrow(table.schema))

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

    def _arrow(got: pa.Schema) -> pa.Schema:
        """The ids in the types of the model table; a column of missing ids has none of its own."""
        types = {f.name: kinds[f.dataType.simpleString()] for f in fields}
        return pa.schema([pa.field(f.name, types.get(f.name, f.type)) for f in got])

    # Points of configurations without a curve are not even read, where files are cut by configuration.
    parts = points.filter(F.col("config").isin(list(known))).mapInArrow(run, schema)
    added = [F.array(*[F.sum(f"{name}_{i}") for i in range(count)]).alias(name) if count > 1 else F.sum(f"{name}_0").alias(name) for name, count in sums.items()]
    kept = [F.flatten(F.collect_list("taken")).alias("taken")] if collect else []
    return parts.groupBy("config", *ids, "interval").agg(*added, *kept)
