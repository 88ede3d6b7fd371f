"""Upstream walk over a table of river reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.operators.reshape import stack_rows
from riffle.session import materialize

# Doublings: reaches farther apart than 2 ** ROUNDS steps cannot occur.
ROUNDS = 40


def mainstem(edges: DataFrame, weight: str) -> DataFrame:
    """Keep the main inflow of every reach: the largest weight, then the smallest id."""
    order = F.struct(F.col(weight), -F.col("comid"))
    best = edges.filter(F.col("comid") != F.col("to_comid")).groupBy("to_comid").agg(
        F.max_by(F.struct("comid", "length_km"), order).alias("inflow"))
    return best.select("inflow.comid", "to_comid", "inflow.length_km")


def upstream(edges: DataFrame, origins: DataFrame, max_km: float = 10.0) -> DataFrame:
    """All reaches within a distance upstream of each origin, the origin included at 0 km.

    ``edges`` are (comid, to_comid, length_km), pointing downstream; the distance of a reach
    counts its own length. All origins walk at once and the step length doubles: after round j
    every reach within 2 ** j steps is known, so a long river takes few joins. Links longer
    than the limit are dropped on the way, which ends the walk.
    """
    jumps = edges.filter((F.col("comid") != F.col("to_comid")) & (F.col("length_km") <= max_km)).select(
        F.col("to_comid").alias("below"), F.col("comid").alias("above"), F.col("length_km").alias("km"))
    jumps = materialize(jumps, "jumps")
    reached = materialize(
        origins.select(F.col("comid").alias("comid_origin")).distinct().withColumns(
            {"comid": F.col("comid_origin"), "km": F.lit(0.0)}), "reached")
    parts = [reached]
    for _ in range(ROUNDS):
        if jumps.isEmpty():
            break
        reached = stack_rows(*parts)
        step = jumps.select("below", "above", F.col("km").alias("step_km"))
        new = (
            reached.join(step, F.col("comid") == F.col("below")).withColumn("km", F.col("km") + F.col("step_km"))
            .filter(F.col("km") <= max_km).select("comid_origin", F.col("above").alias("comid"), "km").distinct()
        )
        parts.append(materialize(new, "reached"))
        upper = jumps.select(F.col("below").alias("middle"), F.col("above").alias("top"), F.col("km").alias("top_km"))
        longer = (
            jumps.join(upper, F.col("above") == F.col("middle")).withColumn("km", F.col("km") + F.col("top_km"))
            .filter(F.col("km") <= max_km).select("below", F.col("top").alias("above"), "km").distinct()
        )
        jumps = materialize(longer, "jumps")
    else:
        raise ValueError("the reaches form a loop without length")
    nearest = stack_rows(*parts).groupBy("comid_origin", "comid").agg(F.min("km").alias("km"))
    return nearest.withColumn("from_gage", F.lit("UM"))


def walk_size(walk: DataFrame) -> DataFrame:
    """Number of origins with and without any upstream reach."""
    sizes = walk.groupBy("comid_origin").agg((F.count("*") > 1).alias("has_upstream"))
    return sizes.groupBy("has_upstream").agg(F.count("*").alias("n"))
