"""The table the models are fitted on: all configurations at once, as key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions.semantics import finite_rows, if_else


def model_frame(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Distinct complete observations per configuration, as ``x`` and ``y``.

    One scan for all configurations; distinct drops copies before anything is shuffled.
    """
    picked = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return finite_rows(picked.na.drop(subset=["x", "y"]), ["x", "y"]).distinct()


def condition(score: Column, threshold: Column) -> Column:
    """0 below the threshold, 1 otherwise, missing when either is missing."""
    return if_else(score < threshold, F.lit(0), F.lit(1))


def direction(x: Column) -> Column:
    """Direction of alteration; zero belongs to neither."""
    return F.when(x > 0, "Pos").when(x < 0, "Neg")
