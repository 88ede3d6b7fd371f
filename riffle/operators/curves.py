"""Regular grids, and the points at which a curve crosses a level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle import constants as C
from riffle.functions.semantics import regular_steps
from riffle.operators.joins import join
from riffle.operators.ranks import stretches, with_last_point

GRID_BLOCK = 10_000


def regular_grid(ranges: DataFrame, start: str, stop: str, step: str, name: str) -> DataFrame:
    """Points from ``start`` to ``stop`` by ``step`` for every row; no rows for a zero step.

    A long grid is generated in blocks by many tasks. The partition count is fixed on purpose:
    sized by bytes, the block list would end in one task.
    """
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = regular_steps(F.col(start), F.col(stop), F.col(step))
    blocks = (
        ranges.withColumn("__last", last).filter(F.col("__last") >= 0)
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__last") / GRID_BLOCK))))
        .repartition(tasks, *[c for c in ranges.columns], "__block")
    )
    first = F.col("__block") * GRID_BLOCK
    index = F.explode(F.sequence(first, F.least(F.col("__last"), first + (GRID_BLOCK - 1))))
    return (
        blocks.withColumn("__i", index)
        .withColumn(name, F.least(F.col(start) + F.col("__i") * F.col(step), F.col(stop)))
        .drop("__last", "__block", "__i")
    )


def grid_ranges(frame: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Range of x per configuration, and the grid step: the absolute mean over 500."""
    return frame.groupBy(*keys).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.abs(F.avg(x) / 500).alias("x_step")
    )


def curve_roots(curve: DataFrame, keys: Sequence[str], x: str, y: str, levels: Mapping[str, Column]) -> DataFrame:
    """First two crossings of each level, in ascending x, and the number of crossings.

    The curve is the line through its points in order of x. Between neighbours on both sides of
    a level the crossing is interpolated. Points exactly on the level count as one crossing, at
    the last of them, if the curve leaves on the other side; a touch counts as none. A level may
    depend on the key columns. Curves that cross nothing have no rows.

    Points are range-partitioned over (keys, x), so a curve of any length is spread over many
    tasks; each stretch of a curve gets the last point of the stretch before it as one extra
    row. Only the few points next to a level go on to the search for crossings, which is done
    for all levels at once.
    """
    keys = list(keys)
    names = list(levels)
    points = (
        curve.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        .filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))
        .distinct()
    )
    cut = stretches(points, keys, ["x", "y"], "curve")
    along = Window.partitionBy(*keys, "stretch").orderBy("own", "x", "y")
    steps = with_last_point(cut, keys).select(
        *keys, "stretch", "x", "y", "own", F.lag("x").over(along).alias("x0"), F.lag("y").over(along).alias("y0")
    ).filter(F.col("own") & F.col("x0").isNotNull())

    # A step matters if it changes the band between levels, or starts or ends on a level.
    truth = lambda c: F.coalesce(c, F.lit(False))
    band = lambda v: sum((truth(v >= levels[n]).cast("int") for n in names), F.lit(0))
    touches = lambda v: reduce(lambda a, b: a | b, [truth(v == levels[n]) for n in names])
    near = steps.filter((band(F.col("y")) != band(F.col("y0"))) | touches(F.col("y")) | touches(F.col("y0")))

    # The side a level was last seen from: y0, or where it lies on the level, an earlier y0.
    # Steps that start on a level follow steps that end on it, so the chain is complete; it may
    # reach back over stretches, of which only those with points on a level have rows here.
    off = lambda j: F.when(F.col("y0") != levels[names[j]], F.col("y0"))
    every = range(len(names))
    in_stretch = Window.partitionBy(*keys, "stretch").orderBy("x", "y").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("x", "y")
    ends = near.groupBy(*keys, "stretch").agg(
        *[F.max_by(off(j), F.when(off(j).isNotNull(), place)).alias(f"end{j}") for j in every]
    ).select(*keys, "stretch", *[F.last(f"end{j}", ignorenulls=True).over(earlier).alias(f"end{j}") for j in every])
    sided = join(near, ends, [*keys, "stretch"]).withColumns({
        f"side{j}": F.coalesce(F.last(off(j), ignorenulls=True).over(in_stretch), F.col(f"end{j}")) for j in every
    })

    def crossing(j: int, name: str) -> Column:
        level = levels[name]
        opposite = F.signum(F.col(f"side{j}") - level) * F.signum(F.col("y") - level) < 0
        between = F.col("x0") - (F.col("y0") - level) * (F.col("x") - F.col("x0")) / F.nullif(
            F.col("y") - F.col("y0"), F.lit(0.0)
        )
        at = F.when(F.col("y0") == level, F.col("x0")).otherwise(between)
        return F.when(opposite, F.struct(F.lit(name).alias("level"), at.alias("root")))

    found = sided.withColumn(
        "hit", F.explode(F.filter(F.array(*[crossing(j, n) for j, n in enumerate(names)]), lambda h: h.isNotNull()))
    ).select(*keys, "stretch", "hit.level", "hit.root")
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys, "level", "stretch").orderBy("root"))
    )
    per_stretch = ranked.groupBy(*keys, "level", "stretch").agg(
        F.count("*").alias("n_roots"),
        F.array_compact(F.array(F.max(F.when(F.col("rank") == 1, F.col("root"))),
                                F.max(F.when(F.col("rank") == 2, F.col("root"))))).alias("roots"),
    )
    # At most two values per stretch meet here.
    merged = per_stretch.groupBy(*keys, "level").agg(
        F.sum("n_roots").alias("n_roots"), F.array_sort(F.flatten(F.collect_list("roots"))).alias("roots")
    )
    return merged.select(
        *keys, "level", F.get("roots", F.lit(0)).alias("Lower"), F.get("roots", F.lit(1)).alias("Upper"), "n_roots"
    )


def class_levels(index: str = "Index") -> dict[str, Column]:
    """The biological threshold of each limit class as a level, chosen by the index."""
    tag = F.col(index)
    return {
        name: F.when(tag == "asci", C.BIO_THRESHOLDS["asci"][name]).when(tag == "csci", C.BIO_THRESHOLDS["csci"][name])
        for name in C.LIMIT_CLASSES
    }


def curve_thresholds(curve: DataFrame, keys: Sequence[str], x: str, y: str, levels: Mapping[str, Column]) -> DataFrame:
    """One row per curve: the first two crossings of every level, and the number of points."""
    roots = curve_roots(curve, keys, x, y, levels)
    hit = lambda name, side: F.max(F.when(F.col("level") == name, F.col(side))).alias(f"Threshold{name}_{side}")
    wide = roots.groupBy(*keys).agg(*[hit(n, s) for n in levels for s in ("Lower", "Upper")])
    sizes = curve.groupBy(*keys).agg(F.count("*").alias("n"))
    return join(sizes, wide, list(keys), "left")
