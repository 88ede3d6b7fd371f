"""Flow values against published limits: altered or not, and in which direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.functions.semantics import if_else, paste, share
from riffle.operators.joins import full_lookup
from riffle.operators.reshape import long_to_wide, wide_to_long

CLASS_KEYS = ["Hydro_Metric", "Biol", "Bio_threshold", "channel_engineering_class"]
STANDARD = (0.79, 0.86)


def published_limits(raw: DataFrame, standard: Sequence[float] = STANDARD) -> DataFrame:
    """Limits at the standard thresholds: one row per metric and level, both signs side by side."""
    kept = raw.filter(F.col("Bio_threshold").isin(*standard)).withColumnRenamed("Hydro_endpoint", "Hydro_Metric")
    named = kept.withColumn("metric", paste(F.col("Bio_endpoint"), F.col("Hydro_Metric"), F.col("Bio_threshold")))
    long = wide_to_long(named, ["Threshold25", "Threshold50", "Threshold75"], "Threshold", "DeltaH")
    keys = [c for c in long.columns if c not in ("Type", "DeltaH")]
    return long_to_wide(long, keys, "Type", "DeltaH", ["Positive", "Negative"])


def label_alteration(delta: DataFrame, limits: DataFrame, limit_rows: int, known: DataFrame | None = None) -> DataFrame:
    """Join deltas to the limits of their metric and test the closed interval.

    A missing delta or limit leaves the label missing. ``known`` may hold the ``Hydro_Metric`` values of ``delta``,
    which are then not looked for in ``delta`` a second time.
    """
    joined = full_lookup(delta, limits, ["Hydro_Metric"], limit_rows, known).na.drop(subset=["Bio_threshold"])
    x = F.col("deltah_final")
    inside = (x <= F.col("Positive")) & (x >= F.col("Negative"))
    return joined.withColumn("Alteration_Current", if_else(inside, F.lit("Unaltered"), F.lit("Altered")))


def _middle(labelled: DataFrame) -> DataFrame:
    return labelled.na.drop(subset=["channel_engineering_class"]).filter(F.col("Threshold") == "Threshold50")


def alteration_share(labelled: DataFrame) -> DataFrame:
    """Percentage of altered and unaltered records per metric, threshold and class."""
    counted = _middle(labelled).groupBy(*CLASS_KEYS, "Alteration_Current").agg(F.count("*").alias("n"))
    shares = counted.withColumn("Percentage", share(F.col("n"), CLASS_KEYS))
    return long_to_wide(shares, CLASS_KEYS, "Alteration_Current", "Percentage", ["Altered", "Unaltered"])


def direction_share(labelled: DataFrame) -> DataFrame:
    """Percentage of the altered records that are above, or below, the limits."""
    altered = _middle(labelled).filter(F.col("Alteration_Current") == "Altered")
    direction = if_else(F.col("deltah_final") > F.col("Positive"), F.lit("High"), F.lit("Low"))
    counted = altered.groupBy(*CLASS_KEYS, direction.alias("Direction")).agg(F.count("*").alias("n"))
    shares = counted.withColumn("Percentage", share(F.col("n"), CLASS_KEYS))
    return long_to_wide(shares, CLASS_KEYS, "Direction", "Percentage", ["High", "Low"])


def alteration_direction(labelled: DataFrame) -> DataFrame:
    """Both percentages, and the direction that holds more than half of the altered records.

    Without any high record the direction is missing. One aggregate counts all labels.
    """
    altered = F.col("Alteration_Current") == "Altered"
    above = F.col("deltah_final") > F.col("Positive")
    counts = _middle(labelled).groupBy(*CLASS_KEYS).agg(
        F.count("*").alias("n"), F.count_if(altered).alias("Altered"), F.count_if(F.col("Alteration_Current") == "Unaltered").alias("Unaltered"),
        F.count_if(altered & above).alias("High"), F.count_if(altered & ~above).alias("Low"))
    percent = lambda name, total: F.when(F.col(name) > 0, 100.0 * F.col(name) / F.col(total)).alias(name)
    shares = counts.select(*CLASS_KEYS, percent("Altered", "n"), percent("Unaltered", "n"), percent("High", "Altered"), percent("Low", "Altered"))
    return shares.withColumn("Direction", if_else(F.col("High") > 50, F.lit("High"), F.lit("Low")))
