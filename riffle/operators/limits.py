"""From curve crossings to flow limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions.semantics import by_index, if_else, paste


def choose_models(
    thresholds: DataFrame,
    six: Mapping[str, Sequence[str]] = C.SMOOTH_SIX,
    quantiles: Sequence[float] = C.CHOSEN_QUANTILES,
) -> DataFrame:
    """Keep the basis size chosen for the index and metric, and the listed quantiles."""
    table = {
        index: {code: 6 if code in six[index] else 3 for code in C.METRIC_CODES.values()} for index in six
    }
    chosen = by_index(F.col("Index"), F.col("Hydro_endpoint"), table)
    return (
        thresholds.withColumn("ChosenSmth", chosen)
        .withColumn("ModelstoUse", if_else(F.col("SmoothingFunc") == F.col("ChosenSmth"), F.lit("Yes"), F.lit("No")))
        .filter((F.col("ModelstoUse") == "Yes") & F.col("Quantile").isin(*quantiles))
    )


def limits_long(thresholds: DataFrame) -> DataFrame:
    """One row per curve and limit class, with its biological threshold and two crossings.

    The class columns are opened in place: no shuffle, unlike melting and pivoting back.
    """
    per_class = F.array(*[
        F.struct(
            F.lit(name).alias("Threshold"),
            F.col(f"Threshold{name}_Lower").cast("double").alias("Lower"),
            F.col(f"Threshold{name}_Upper").cast("double").alias("Upper"),
        )
        for name in C.LIMIT_CLASSES
    ])
    metric = paste(F.col("Index"), F.col("Hydro_endpoint"))
    opened = thresholds.select(
        "Index", "Hydro_endpoint", F.col("SmoothingFunc").cast("int").alias("SmoothingFunc"), "Quantile",
        metric.alias("metric"), F.inline(per_class),
    )
    return opened.withColumns({
        "BioThresh": by_index(F.col("Index"), F.col("Threshold"), C.BIO_THRESHOLDS),
        "MetricCurve": paste(F.col("metric"), F.col("SmoothingFunc"), F.col("Quantile")),
    })


def delta_range(df: DataFrame, delta: str = "deltah_final") -> tuple[Column, Column]:
    """Smallest and largest delta, as scalar subqueries."""
    known = df.filter(F.col(delta).isNotNull() & ~F.isnan(delta))
    return known.select(F.min(delta)).scalar(), known.select(F.max(delta)).scalar()


def adjust_limits(
    limits: DataFrame,
    min_delta: Column | float,
    max_delta: Column | float,
    above: Sequence[str] = C.ABOVE_CURVES,
    below: Sequence[str] = C.BELOW_CURVES,
) -> DataFrame:
    """Turn one or two crossings into a closed interval of acceptable deltas.

    The lower limit is the negative crossing closest to zero, the upper limit the first
    positive one; a side without crossing is open, that is, at the extreme delta. A curve
    known to stay above its threshold accepts everything; one known to stay below accepts
    only an unaltered flow, [0, 0]. A curve with no crossing that is on neither list counts
    as below for the median and as above for higher quantiles.

    Two positive crossings (5, 9) give [min, 5]: the first positive crossing is an upper
    limit and leaves the lower side open.
    """
    lowest = F.lit(min_delta) if not isinstance(min_delta, Column) else min_delta
    highest = F.lit(max_delta) if not isinstance(max_delta, Column) else max_delta
    first, second, curve = F.col("Lower"), F.col("Upper"), F.col("MetricCurve")

    negative = F.when(second < 0, second).when(first <= 0, first)
    positive = F.when(first > 0, first).when((first <= 0) & (second >= 0), second)
    listed = (
        F.when(first.isNull() & curve.isin(*below), "Below")
        .when(second.isNull() & curve.isin(*above), "Above")
        .otherwise("Passes")
    )
    open_curve = F.col("Lower2").isNull() & F.col("Upper2").isNull() & (F.col("CurveStatus") == "Passes")
    status = F.when(open_curve, if_else(F.col("Quantile") == 0.5, F.lit("Below"), F.lit("Above"))).otherwise(
        F.col("CurveStatus")
    )
    below_all, above_all = F.col("CurveStatus") == "Below", F.col("CurveStatus") == "Above"
    return (
        limits.withColumns({"Lower2": negative, "Upper2": positive, "CurveStatus": listed})
        .withColumn("CurveStatus", status)
        .withColumns({
            "Lower2": F.when(below_all, 0.0).when(above_all, lowest).otherwise(F.coalesce(F.col("Lower2"), lowest)),
            "Upper2": F.when(below_all, 0.0).when(above_all, highest).otherwise(F.coalesce(F.col("Upper2"), highest)),
        })
        .drop("Lower", "Upper", "MetricCurve")
    )
