"""Order statistics and neighbours along an order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.operators.joins import join
from riffle.session import BROADCAST_ROWS, materialize

# Slices of the range of a group, of which only those with an asked rank are ranked.
SLICES = 64


def stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Cut every group into stretches along an order, whatever the size of the group.

    Rows are range-partitioned over keys and order, and the partition number is written with
    them, so the cuts stay the same when a task is run again.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("stretch", F.spark_partition_id())
    return materialize(ranged, name)


def with_last_point(cut: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add to every stretch the last point (x, y) of the stretch before it.

    Added rows have ``own`` false and come first in order of (own, x, y).
    """
    keys = list(keys)
    ends = cut.groupBy(*keys, "stretch").agg(F.max(F.struct("x", "y")).alias("end"))
    before = F.lag("end").over(Window.partitionBy(*keys).orderBy("stretch"))
    carried = ends.withColumn("end", before).filter(F.col("end").isNotNull()).select(
        *keys, "stretch", "end.x", "end.y", F.lit(False).alias("own"))
    return cut.withColumn("own", F.lit(True)).unionByName(carried)


def next_point(curve: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The following point of the curve on every point, in order of x."""
    keys = list(keys)
    points = curve.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    cut = stretches(points, keys, ["x", "y"], "points")
    starts = cut.groupBy(*keys, "stretch").agg(F.min(F.struct("x", "y")).alias("start"))
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("stretch"))
    ahead = (
        starts.withColumn("start", following).filter(F.col("start").isNotNull())
        .select(*keys, "start.x", "start.y", "stretch", F.lit(False).alias("own"))
    )
    along = Window.partitionBy(*keys, "stretch").orderBy(F.col("own").desc(), "x", "y")
    return (
        cut.withColumn("own", F.lit(True)).unionByName(ahead)
        .select(*keys, "x", "y", F.lead("x").over(along).alias("x_next"), F.lead("y").over(along).alias("y_next"), "own")
        .filter("own").drop("own")
    )


def box_summary(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Quartiles (linear interpolation), whiskers within 1.5 of their distance, and outliers.

    Exact: equal values are counted first, then ranked in stretches, so no task holds a group.
    """
    keys = list(keys)
    values = (
        df.filter(F.col(x).isNotNull() & ~F.isnan(x)).groupBy(*keys, F.col(x).alias("x")).agg(F.count("*").alias("c"))
    )
    cut = stretches(values, keys, ["x"], "ranks")
    groups = Window.partitionBy(*keys)
    sizes = cut.groupBy(*keys, "stretch").agg(F.sum("c").alias("size")).select(
        *keys, "stretch", F.sum("size").over(groups).alias("total"),
        (F.sum("size").over(groups.orderBy("stretch")) - F.col("size")).alias("offset"),
    )
    inside = Window.partitionBy(*keys, "stretch").orderBy("x")
    ranked = join(cut, sizes, [*keys, "stretch"]).withColumn("last", F.col("offset") + F.sum("c").over(inside) - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("last") - F.col("c")) & (rank <= F.col("last")), F.col("x")))

    def quantile(p: float) -> Column:
        place = (F.col("total") - 1) * p
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + F.max(place - F.floor(place)) * (high - low)

    box = ranked.groupBy(*keys).agg(
        quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"),
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inner = (F.col("x") >= F.col("q1") - reach) & (F.col("x") <= F.col("q3") + reach)
    return join(cut, box, keys).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inner, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inner, F.col("x"))).alias("whisker_high"),
        F.sum(F.when(inner, 0).otherwise(F.col("c"))).alias("n_outliers"),
        F.sum("c").alias("n"),
    )


def discrete_quantiles(df: DataFrame, keys: Sequence[str], x: str, quantiles: Sequence[float]) -> DataFrame:
    """(keys, ``Quantile``, ``x``): the smallest value that at least the given share of a group does not exceed.

    Exact. Rows are counted in slices of the range of their group, and only those in a slice that holds an asked rank are
    ranked: equal values are counted first, then ranked in stretches, so no task holds a group. ``df`` is read three times.
    Missing values are left out; a group without values has no rows.
    """
    keys = list(keys)
    df = df.filter(F.col(x).isNotNull() & ~F.isnan(x)).select(*keys, F.col(x).alias("x"))
    wide = F.col("x").cast("double")
    finite = F.when(F.abs(wide) < float("inf"), wide)
    ranges = materialize(df.groupBy(*keys).agg(F.count("*").alias("total"), F.min(finite).alias("low"), F.max(finite).alias("high")), "ranges")
    groups = ranges.count()
    few = lambda table: F.broadcast(table) if groups * len(quantiles) <= BROADCAST_ROWS else table
    # The slice never falls as x rises, so all of a lower slice is below all of a higher one. Halves cannot overflow.
    share = F.floor((wide / 2 - F.col("low") / 2) / F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0)) * SLICES)
    at = F.when(wide < F.col("low"), 0).when(wide > F.col("high"), SLICES - 1).otherwise(F.least(F.coalesce(share, F.lit(0)), F.lit(SLICES - 1)))
    placed = join(df, few(ranges.drop("total")), keys).select(*keys, "x", F.coalesce(at, F.lit(0)).cast("int").alias("slice"))

    # At most SLICES rows for each group.
    sliced = join(placed.groupBy(*keys, "slice").agg(F.count("*").alias("rows")), few(ranges.select(*keys, "total")), keys)
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("slice")) - F.col("rows")
    asked = [F.greatest(F.col("total") - F.floor(F.col("total") - F.lit(float(q)) * F.col("total")), F.lit(1)) for q in quantiles]
    here = reduce(lambda a, b: a | b, [(n > F.col("before")) & (n <= F.col("before") + F.col("rows")) for n in asked])
    needed = materialize(sliced.withColumn("before", before).where(here).select(*keys, "slice", "before", "total"), "slices")

    group = [*keys, "slice"]
    counted = join(placed, few(needed.select(*group)), group).groupBy(*group, "x").agg(F.count("*").alias("rows"))
    cut = stretches(counted, group, ["x"], "quantiles")
    earlier = F.sum("rows").over(Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each stretch of a slice.
    offsets = cut.groupBy(*group, "stretch").agg(F.sum("rows").alias("rows")).select(*group, "stretch", F.coalesce(earlier, F.lit(0)).alias("offset"))
    offsets = join(offsets, needed, group)
    upto = F.col("before") + F.col("offset") + F.sum("rows").over(Window.partitionBy(*group, "stretch").orderBy("x"))
    ranked = join(cut, offsets, [*group, "stretch"]).select(*keys, "x", "total", upto.alias("upto"))

    def value(q: float, n: Column) -> Column:
        return F.struct(F.lit(float(q)).alias("Quantile"), F.min(F.when(F.col("upto") >= n, F.col("x"))).alias("x"))

    return ranked.groupBy(*keys).agg(F.array(*[value(q, n) for q, n in zip(quantiles, asked)]).alias("found")).select(*keys, F.inline("found"))
