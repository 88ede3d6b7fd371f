"""Joins with missing keys and with hot keys."""

from pyspark.sql import functions as F

from riffle.operators import joins as J
from riffle.operators import ranks, reshape


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, y string")
    both = [(1, "a", "p"), (None, "b", "q")]
    assert rows(J.join(a, b, ["k"])) == sorted(both, key=str)
    assert rows(J.join(a, b, ["k"], "left")) == sorted(both + [(3, "c", None)], key=str)
    assert rows(J.join(a, b, ["k"], "right")) == sorted(both + [(4, None, "r")], key=str)
    full = sorted(both + [(3, "c", None), (4, None, "r")], key=str)
    assert rows(J.join(a, b, ["k"], "full")) == full
    assert rows(J.full_lookup(a, b, ["k"], rows=3)) == full


def test_differently_named_keys(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (3, "q")], "j int, y string")
    assert rows(J.join(a, b, {"k": "j"}, "right")) == [(1, "a", "p"), (3, None, "q")]
    assert rows(J.join(a, b, {"k": "j"}, "full")) == [(1, "a", "p"), (2, "b", None), (3, None, "q")]


def test_membership(spark):
    a = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    v = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(J.within(a, v, ["k"])) == [(1,)]
    assert rows(J.without(a, v, ["k"])) == sorted([(3,), (None,)], key=str)


def test_pairs_of_a_hot_key_equal_plain_join(spark):
    left = spark.range(60).select(F.when(F.col("id") < 20, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("h"), F.col("id").alias("gage"))
    right = spark.range(90).select(F.when(F.col("id") < 40, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("h"), F.col("id").alias("site"))
    copies = right.unionByName(right)
    want = rows(left.join(right, "h").select("h", "gage", "site"))
    assert rows(J.pair_by_key(left, copies, "h", rows_per_slice=3).select("h", "gage", "site")) == want


def test_pairs_without_a_hot_key_are_dealt_out_once(spark):
    """One shuffle of either side, by the key; missing keys pair with nothing (F1)."""
    left = spark.range(40).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("h"), (F.col("id") % 9).alias("gage"))
    right = spark.range(60).select((F.col("id") % 7).cast("string").alias("site"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("h"))
    found = J.pair_by_key(left, right, "h")
    assert found.columns == ["h", "gage", "site"]
    assert rows(found) == rows(left.join(right, "h").distinct())
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 2


def test_pairs_of_hot_and_other_keys(spark):
    """A key is hot by either side; copies count once; a side of nothing but the key multiplies nothing (F1)."""
    left = spark.range(50).select(F.when(F.col("id") < 30, "hot").when(F.col("id") < 33, "k").alias("h"), (F.col("id") % 25).alias("gage"))
    right = spark.range(70).select(F.when(F.col("id") < 9, "hot").when(F.col("id") < 60, "k").alias("h"), F.col("id").alias("site"))
    want = rows(left.join(right, "h").distinct())
    assert rows(J.pair_by_key(left, right, "h", rows_per_slice=10)) == want
    assert rows(J.pair_by_key(left, right, "h", rows_per_slice=1)) == want
    assert rows(J.pair_by_key(left.select("h"), right, "h", rows_per_slice=10)) == rows(right.filter("h IS NOT NULL"))


def test_first_per_key_breaks_ties_by_content(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 9, "z"), (2, None, "n")], "k int, o int, v string")
    assert rows(J.first_per_key(df, ["k"], ["o"])) == [(1, 5, "a"), (2, None, "n")]


def test_config_grid_size(spark):
    grid = J.config_grid(spark.createDataFrame([("csci",), ("asci",)], "b string"), smooth=[3, 6], q=[0.5, 0.9, 0.99])
    assert grid.count() == 12 and grid.distinct().count() == 12


def test_overall_classes_and_pivot(spark):
    df = spark.createDataFrame([("s1", "NAT"), ("s1", "NAT"), ("s2", None)], "id string, c string")
    got = rows(reshape.with_overall_classes(df, "c"))
    assert len(got) == 8 and ("s2", None) in got
    long = spark.createDataFrame([("a", "x", 1.0), ("a", "zz", 2.0)], "k string, n string, v double")
    assert rows(reshape.long_to_wide(long, ["k"], "n", "v", ["x", "y"], fill=0.0)) == [("a", 1.0, 0.0)]


def test_box_summary_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([rng.normal(size=300), [50.0, -40.0], [1.0] * 100]), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None)], "g string, x double")
    for r in ranks.box_summary(df, ["g"], "x").collect():
        v = data[r.g]
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        near = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r.q1, r.median, r.q3, r.whisker_low, r.whisker_high], [q1, q2, q3, near.min(), near.max()])
        assert (r.n, r.n_outliers) == (len(v), len(v) - len(near))
