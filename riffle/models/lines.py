"""Straight lines: least squares from one aggregate, and linear quantile regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.models.spline import fit_quantile


def fit_lines(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slope, intercept and R2 per configuration; NULL where x is constant."""
    return frame.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("R2"),
    )


def fit_quantile_lines(frame: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = C.LINE_QUANTILES) -> DataFrame:
    """Slope and intercept of a straight line per configuration and quantile."""
    models = fit_quantile(frame, keys, [2], quantiles)
    low, high = F.get("breaks", F.lit(0)), F.get("breaks", F.lit(1))
    slope = F.get("pieces", F.lit(1)) / F.when(high > low, high - low)
    return models.select(
        *keys, "quantile", "n", "status", slope.alias("slope"), (F.get("pieces", F.lit(0)) - slope * low).alias("intercept"),
        (F.col("below") / F.col("n")).alias("share_below"))
