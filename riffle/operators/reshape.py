"""Wide and long forms, unions, and membership in overall classes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle import constants as C


def wide_to_long(df: DataFrame, columns: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """One row per listed column; missing values keep their row."""
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), names_to, values_to)


def long_to_wide(
    df: DataFrame, keys: Sequence[str], names_from: str, values_from: str, names: Sequence[str], fill=None
) -> DataFrame:
    """One column per listed name. The list fixes the schema; unlisted names are left out.

    ``values_from`` must be unique per key and name.
    """
    wide = df.groupBy(*keys).pivot(names_from, list(names)).agg(F.first(values_from, ignorenulls=True))
    return wide if fill is None else wide.na.fill(fill, list(names))


def stack_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; a column that a table lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_class_sets(df: DataFrame, column: str, overall: Sequence[str] = C.OVERALL_CLASSES) -> DataFrame:
    """Equal records once, with the set of their classes and the overall classes as an array in place of the class.

    The set holds a handful of values. A missing class stays a class of its own.
    """
    rest = [c for c in df.columns if c != column]
    own = df.groupBy(*rest).agg(F.collect_set(column).alias("__own"), F.bool_or(F.col(column).isNull()).alias("__missing"))
    classes = F.concat("__own", F.array(*[F.lit(c) for c in overall]), F.when(F.col("__missing"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    return own.withColumn(column, F.array_distinct(classes)).select(*df.columns)


def with_overall_classes(df: DataFrame, column: str, overall: Sequence[str] = C.OVERALL_CLASSES) -> DataFrame:
    """Each record once under its own class and once under each overall class, no duplicates.

    Equal records are merged first, with the set of their classes (a handful of values), and multiplied afterwards:
    one row per record is shuffled, not one per record and class. A missing class stays a class of its own.
    """
    return with_class_sets(df, column, overall).withColumn(column, F.explode(column))


def count_columns(names: dict[str, Column]) -> list[Column]:
    """Aggregates of a counting pivot: one column per name, NULL where nothing was counted.

    One pass and one shuffle, unlike count followed by pivot.
    """
    return [F.nullif(F.count_if(condition), F.lit(0)).alias(name) for name, condition in names.items()]
