"""Connected components by contraction, as joins of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.session import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(``key``, ``least``) for each end of ``links`` (``a``, ``b``): the smallest key that can be reached from it.

    In each round every vertex hooks to its least neighbour, if that is smaller, the trees this makes are flattened
    by pointer jumping, and the links are redrawn between their roots. At least half of the vertices with links
    vanish in a round, so links and rounds shrink fast. All tables are written; sums run before the shuffle.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = edges.where("false").select(F.col("a").alias("key"), F.col("b").alias("least"))
    while edges.limit(1).count():
        # Links go from the smaller to the larger end: each larger end hooks to the smallest of its smaller ones.
        trees = materialize(edges.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("least")), "trees")
        while True:
            above = trees.select(F.col("key").alias("least"), F.col("least").alias("far"))
            if not trees.join(above, "least", "left_semi").limit(1).count():
                break
            flatter = materialize(trees.join(above, "least", "left").select("key", F.coalesce("far", "least").alias("least")), "trees")
            release(trees)
            trees = flatter
        root = trees.withColumnRenamed("least", "root")
        redrawn = edges.join(root.withColumnRenamed("key", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        redrawn = redrawn.join(root.withColumnRenamed("key", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
        redrawn = redrawn.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        # A vertex that was labelled before now has the root of its label.
        moved = labels.join(root.withColumnRenamed("key", "least"), "least", "left").select("key", F.coalesce("root", "least").alias("least"))
        fresh = trees.join(labels.select("key"), "key", "left_anti")
        new, fewer = materialize(moved.union(fresh), "labels"), materialize(redrawn, "links")
        for table in (edges, labels, trees):
            release(table)
        edges, labels = fewer, new
    release(edges)
    roots = labels.select(F.col("least").alias("key"), "least").distinct()
    return labels.union(roots)
