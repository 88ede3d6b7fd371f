"""Joins in which a missing key matches a missing key, and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.session import BROADCAST_ROWS, materialize

# A group larger than this is cut into slices when groups are paired.
ROWS_PER_SLICE = 50_000


def _keys(on: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    return dict(on) if isinstance(on, Mapping) else {name: name for name in on}


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str], how: str = "inner") -> DataFrame:
    """Equi join; NULL keys match each other. Keys appear once, under the left name.

    ``how`` is inner, left, right or full. The kinds are built from inner and left joins, so
    that the adaptive skew handling may split a hot key (it never splits a full join).
    """
    keys = _keys(on)
    if how == "right":
        flipped = join(right, left, {b: a for a, b in keys.items()}, "left")
        flipped = flipped.withColumnsRenamed({b: a for a, b in keys.items()})
        return flipped.select(*left.columns, *[c for c in right.columns if c not in keys.values()])
    if how == "full":
        matched = join(left, right, keys, "left")
        known = left.select(*keys).distinct()
        alone = without(right, known, {b: a for a, b in keys.items()})
        alone = alone.withColumnsRenamed({b: a for a, b in keys.items()})
        return matched.unionByName(alone, allowMissingColumns=True)
    renamed = {b: f"__{b}" for b in keys.values()}
    other = right.withColumnsRenamed(renamed)
    condition = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(renamed[b])) for a, b in keys.items()])
    return left.join(other, condition, how).drop(*renamed.values())


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Sorted names of the columns both tables have, for a join on all of them."""
    return sorted(set(left.columns) & set(right.columns))


def _membership(df: DataFrame, values: DataFrame, on, how: str) -> DataFrame:
    keys = _keys(on)
    renamed = {b: f"__{b}" for b in keys.values()}
    other = values.select(*keys.values()).withColumnsRenamed(renamed).distinct()
    condition = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(renamed[b])) for a, b in keys.items()])
    return df.join(other, condition, how)


def within(df: DataFrame, values: DataFrame, on) -> DataFrame:
    """Rows whose key occurs among the values."""
    return _membership(df, values, on, "left_semi")


def without(df: DataFrame, values: DataFrame, on) -> DataFrame:
    """Rows whose key does not occur among the values; a NULL key stays unless NULL is listed."""
    return _membership(df, values, on, "left_anti")


def lookup(df: DataFrame, small: DataFrame, on, rows: int | None = None) -> DataFrame:
    """Left join to a dimension; it is broadcast only when its row count is known to be small.

    ``rows`` is the proven row count: of a table of fixed values, or counted by the caller.
    Without it the optimizer chooses from sizes seen at run time.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return join(df, small, on, "left")


def full_lookup(df: DataFrame, small: DataFrame, on, rows: int, known: DataFrame | None = None) -> DataFrame:
    """Full join to a dimension of known size: the large table is not shuffled by the key.

    Keys that only the dimension has are found against the distinct keys of the table, or
    against ``known``, if the caller has a cheaper table with the same keys.
    """
    keys = _keys(on)
    alone = without(small, (df if known is None else known).select(*keys), {b: a for a, b in keys.items()})
    alone = alone.withColumnsRenamed({b: a for a, b in keys.items()})
    return lookup(df, small, on, rows).unionByName(alone, allowMissingColumns=True)


def pair_by_key(left: DataFrame, right: DataFrame, key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """All left/right pairs that share a key, without duplicates.

    The pairs of a hot key are the result and cannot be fewer, but no single task makes them
    all: the rows of a key are cut into slices by their content on either side, and each slice
    of one side meets each slice of the other in a task of its own. Duplicates go before the
    join, so equal copies of a row cannot fill one slice.

    The rows of a key are counted first. Keys without a second slice are dealt out once, and lose
    their duplicates and meet their pairs where they lie; only those that have more are cut. A side
    of nothing but the key has one row of each, so nothing is multiplied.
    """
    if [key] in (left.columns, right.columns):
        return _paired(left.distinct(), right.distinct(), [key])
    counts = [side.groupBy(key).agg(F.count("*").alias("__n")) for side in (left, right)]
    hot = counts[0].filter(F.col("__n") > rows_per_slice).select(key).unionByName(counts[1].filter(F.col("__n") > rows_per_slice).select(key))
    hot = materialize(hot.na.drop().distinct(), "hot")
    rows = hot.count()
    if not rows:
        return _paired(*[side.repartition(key).distinct() for side in (left, right)], [key])
    listed = F.broadcast(hot) if rows <= BROADCAST_ROWS else hot
    plain = _paired(*[without(side, listed, [key]).repartition(key).distinct() for side in (left, right)], [key])
    return plain.unionByName(_sliced(*[within(side, listed, [key]) for side in (left, right)], key, rows_per_slice))


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi join on keys of which a missing one matches nothing; columns in the order of the sides."""
    renamed = {k: f"__{k}" for k in keys}
    condition = reduce(lambda x, y: x & y, [F.col(a) == F.col(b) for a, b in renamed.items()])
    return left.join(right.withColumnsRenamed(renamed), condition).drop(*renamed.values())


def _sliced(left: DataFrame, right: DataFrame, key: str, rows_per_slice: int) -> DataFrame:
    """Pairs of hot keys: every slice of one side with every slice of the other."""
    left, right = left.distinct(), right.distinct()

    def slices(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(F.col(key).alias("__key")).agg(F.ceil(F.count("*") / F.lit(rows_per_slice)).cast("int").alias(name))

    cuts = slices(left, "__lefts").join(slices(right, "__rights"), "__key")

    def cut(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = side.join(cuts, F.col(key) == F.col("__key"))
        part = F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int").alias(f"{own}_part")
        return placed.select(*side.columns, part, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_part"))

    parts = ["__lefts_part", "__rights_part"]
    return _paired(cut(left, "__lefts", "__rights"), cut(right, "__rights", "__lefts"), [key, *parts]).drop(*parts)


def config_grid(df: DataFrame, **lists: Sequence) -> DataFrame:
    """Every row of ``df`` with every combination of the listed values."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in a stated order, all columns kept.

    An aggregate rather than a window: every task keeps one row per key before the shuffle.
    Ties are broken by the remaining columns, so the result does not depend on row order.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = [F.col(c) if isinstance(c, str) else c for c in order]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ordering)], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)
