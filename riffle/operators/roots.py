"""Crossings of fitted curves with levels, from the polynomial pieces of the model table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.operators.joins import join

# Halvings of a bracket from 0 to 1: more than a double can tell apart.
HALVINGS = 60
_VALUE = "c0 + {u} * (c1 + {u} * (c2 + {u} * c3))"


def curve_segments(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of x on which each fitted curve only rises, only falls or is level, in ascending order.

    A piece is a cubic in u from 0 to 1, so its turning points are the roots of a quadratic. Models without a curve
    have no rows. Gamma curves stay on the log scale.
    """
    usable = models.filter(F.col("pieces").isNotNull() & (F.size("breaks") > 1))
    opened = usable.select(*keys, "family", "breaks", "pieces", F.explode(F.sequence(F.lit(0), F.size("breaks") - 2)).alias("piece"))
    cubic = opened.select(
        *keys, "family", "piece", F.expr("get(breaks, piece)").alias("low"), F.expr("get(breaks, piece + 1) - get(breaks, piece)").alias("width"),
        *[F.expr(f"get(pieces, piece * 4 + {j})").alias(f"c{j}") for j in range(4)])
    # Roots of c1 + 2 c2 u + 3 c3 u^2 without a difference of equal numbers.
    spread = F.expr("CASE WHEN c2 * c2 >= 3 * c1 * c3 THEN sqrt(c2 * c2 - 3 * c1 * c3) END")
    turned = cubic.withColumn("q", -(F.col("c2") + F.when(F.col("c2") < 0, -spread).otherwise(spread)))
    nodes = F.expr("array_sort(array_distinct(concat(array(0d, 1d), filter(array(q / nullif(3 * c3, 0d), c1 / nullif(q, 0d)), u -> u > 0 AND u < 1))))")
    cut = turned.withColumn("nodes", nodes).withColumn("part", F.explode(F.sequence(F.lit(0), F.size("nodes") - 2)))
    return cut.select(
        *keys, "family", "piece", "part", "low", "width", "c0", "c1", "c2", "c3",
        F.expr("get(nodes, part)").alias("u0"), F.expr("get(nodes, part + 1)").alias("u1"))


def model_roots(models: DataFrame, keys: Sequence[str], levels: Mapping[str, Column]) -> DataFrame:
    """First two crossings of each level by each fitted curve, in ascending x, and the number of crossings.

    ``keys`` tell the models apart; a level may depend on them. A curve runs over the range of its observations. A
    touch is no crossing; a curve that lies on the level for a while crosses at the end of that stretch, if it leaves
    on the other side. Curves that cross nothing have no rows. For Gamma models the level is that of the mean.

    Only the model table is read: a root is bracketed by the turning points of its piece and found by halving, so no
    grid of points is made and the result is exact to rounding. All windows are over the pieces of one model.
    """
    keys = list(keys)
    along = Window.partitionBy(*keys).orderBy("piece", "part")
    begin, end = F.expr(_VALUE.format(u="u0")), F.expr(_VALUE.format(u="u1"))
    # Where two pieces meet their values differ by rounding; one of them stands for both.
    steps = curve_segments(models, keys).withColumn("y0", begin).withColumn("y1", F.coalesce(F.lead("y0").over(along), end))
    named = F.array(*[F.struct(F.lit(n).alias("level"), v.cast("double").alias("value")) for n, v in levels.items()])
    each = steps.select("*", F.explode(named).alias("l")).select("*", "l.*").drop("l")
    each = each.withColumn("value", F.when(F.col("family") != "gamma", F.col("value")).when(F.col("value") > 0, F.log("value"))).filter("value IS NOT NULL")
    so_far = Window.partitionBy(*keys, "level").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, 0)
    sided = each.withColumn("side", F.last(F.when(F.col("y0") != F.col("value"), F.col("y0")), ignorenulls=True).over(so_far))
    crossed = sided.filter(F.signum(F.col("side") - F.col("value")) * F.signum(F.col("y1") - F.col("value")) < 0)
    middle = "((s.a + s.b) / 2)"
    halved = F.expr(
        f"aggregate(sequence(1, {HALVINGS}), struct(u0 AS a, u1 AS b), (s, i) -> if(signum({_VALUE.format(u=middle)} - value) = signum(y0 - value),"
        f" struct({middle} AS a, s.b AS b), struct(s.a AS a, {middle} AS b)), s -> (s.a + s.b) / 2)")
    place = F.when(F.col("y0") == F.col("value"), F.col("u0")).otherwise(halved)
    found = crossed.select(*keys, "level", (F.col("low") + place * F.col("width")).alias("root"))
    # As many roots as a model has stretches, at most.
    merged = found.groupBy(*keys, "level").agg(F.count("*").alias("n_roots"), F.array_sort(F.collect_list("root")).alias("roots"))
    return merged.select(*keys, "level", F.get("roots", F.lit(0)).alias("Lower"), F.get("roots", F.lit(1)).alias("Upper"), "n_roots")


def model_thresholds(models: DataFrame, keys: Sequence[str], levels: Mapping[str, Column]) -> DataFrame:
    """One row per model, failed ones too: the first two crossings of every level, the observations and the status."""
    roots = model_roots(models, keys, levels)
    hit = lambda name, side: F.max(F.when(F.col("level") == name, F.col(side))).alias(f"Threshold{name}_{side}")
    wide = roots.groupBy(*keys).agg(*[hit(n, s) for n in levels for s in ("Lower", "Upper")])
    return join(models.select(*keys, "n", "status"), wide, list(keys), "left")
