"""Projection, point in polygon, pairs and the upstream walk."""

import random

import pytest
from pyspark.sql import functions as F

from riffle.geo import geometry as G
from riffle.geo import rivers, watersheds
from riffle.operators import joins as J

SHAPE = "id string, rings array<array<struct<x:double,y:double>>>"


def square(x, y, size=1.0):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def test_point_in_polygon_edges(spark):
    shapes = spark.createDataFrame([("a", [square(0.0, 0.0)]), ("b", [square(1.0, 0.0)]), ("hole", [square(5.0, 5.0, 3.0), square(6.0, 6.0)])], SHAPE)
    points = spark.createDataFrame([
        ("in_a", 0.5, 0.5), ("in_b", 1.5, 0.5), ("out", 3.0, 3.0), ("lower", 0.5, 0.0), ("upper", 0.5, 1.0), ("shared", 1.0, 0.5),
        ("corner", 0.0, 0.0), ("in_hole", 6.5, 6.5), ("ring", 5.5, 5.5), ("nowhere", None, 1.0)], "p string, x double, y double")
    got = {r.p: r.id for r in G.point_in_polygon(points, shapes, "x", "y", ["id"]).collect()}
    assert got == {"in_a": "a", "in_b": "b", "out": None, "lower": "a", "upper": None, "shared": "b", "corner": "a",
                   "in_hole": None, "ring": "hole", "nowhere": None}


def test_point_in_polygon_against_brute_force(spark):
    rng = random.Random(4)
    shapes = []
    for i in range(40):
        cx, cy, r = rng.uniform(-5, 5), rng.uniform(-5, 5), 2.0 ** rng.randint(-4, 3)
        shapes.append((f"s{i}", [[(cx + r * rng.uniform(0.3, 1) * dx, cy + r * rng.uniform(0.3, 1) * dy) for dx, dy in [(1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (0, -1)]]]))
    points = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(300)]

    def hit(x, y, ring):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return n % 2 == 1

    want = {(i, s) for i, x, y in points for s, rings in shapes if hit(x, y, rings[0])}
    found = G.point_in_polygon(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(shapes, SHAPE), "x", "y", ["id"])
    rows = found.collect()
    assert {(r.p, r.id) for r in rows if r.id} == want
    assert {r.p for r in rows if r.id is None} == {i for i, *_ in points} - {i for i, _ in want}


def test_point_in_polygon_broadcasts_no_side(spark):
    """Small estimates of opened cells and positions say nothing of their size (F1 to F4)."""
    shapes = spark.createDataFrame([("a", [square(0.0, 0.0)])], SHAPE)
    points = spark.createDataFrame([("p", 0.5, 0.5)], "p string, x double, y double")
    found = G.point_in_polygon(points, shapes, "x", "y", ["id"])
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("p", 0.5, 0.5, "a")]


def test_point_in_polygon_repeated_and_missing_names(spark):
    """Polygons of one name give a point once; a missing name counts as a name; equal points all stay."""
    shapes = spark.createDataFrame(
        [("a", [square(0.0, 0.0, 2.0)]), ("a", [square(0.0, 0.0, 9.0)]), ("b", [square(0.0, 0.0)]), (None, [square(0.0, 0.0)]), (None, [square(0.0, 0.0)])], SHAPE)
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 5.0, 5.0), (3, 50.0, 5.0), (4, float("nan"), 1.0)], "p int, x double, y double")
    got = sorted(((r.p, r.id) for r in G.point_in_polygon(points, shapes, "x", "y", ["id"]).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (1, None)] * 2 + [(2, "a"), (3, None), (4, None)], key=str)


@pytest.mark.parametrize("corners", [7, 30])
def test_compiled_and_array_tests_agree_with_brute_force(spark, corners):
    """Up to 8 edges are tested by compiled code, more of them in an array; missing corners cross nothing (F1)."""
    rng = random.Random(corners)
    shapes = [(f"s{i}", [[(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(rng.randint(3, corners))]]) for i in range(20)]
    shapes += [("gap", [[(0.0, 0.0), (None, 2.0), (2.0, 2.0), (2.0, 0.0)]]), ("none", None), ("empty", [])]
    points = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(200)]

    def hit(x, y, ring):
        if not all(min(known) <= v <= max(known) for v, axis in zip((x, y), zip(*ring)) for known in [[c for c in axis if c is not None]]):
            return False  # of a ring with a missing corner only the box of the others counts
        edges = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1]) if None not in (*a, *b)]
        return sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in edges) % 2 == 1

    want = {(i, s) for i, x, y in points for s, rings in shapes if rings and hit(x, y, rings[0])}
    table, polygons = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(shapes, SHAPE)
    found = G.point_in_polygon(table, polygons, "x", "y", ["id"])
    assert {(r.p, r.id) for r in found.collect() if r.id} == want
    assert ("lambdafunction" in found._jdf.queryExecution().optimizedPlan().toString().split("LocalRelation")[0].split("Generate")[0]) == (corners > 8)
    assert {r.id for r in G.holding(polygons, table, "x", "y", ["id"]).collect()} == {s for _, s in want}


def test_holding_keeps_all_polygons_of_a_name(spark):
    """A name that holds a point in one polygon keeps its others, where the other side of a pair may lie (F1)."""
    shapes = spark.createDataFrame(
        [("a", [square(0.0, 0.0)]), ("a", [square(7.0, 7.0)]), ("b", [square(0.0, 0.0, 9.0)]), ("c", [square(20.0, 0.0)]), (None, [square(0.0, 0.0)])], SHAPE)
    points = spark.createDataFrame([(0.5, 0.5), (0.5, 0.5), (None, 0.5), (20.5, None), (float("nan"), 0.5)], "x double, y double")
    assert sorted((str(r.id), r.rings[0][0].x) for r in G.holding(shapes, points, "x", "y", ["id"]).collect()) == [("None", 0.0), ("a", 0.0), ("a", 7.0), ("b", 0.0)]
    assert G.holding(shapes, points.limit(0), "x", "y", ["id"]).collect() == [] and G.holding(shapes.limit(0), points, "x", "y", ["id"]).collect() == []


def crossed_tables(spark):
    shapes = spark.createDataFrame([("a", [square(0.0, 0.0)]), ("b", [square(2.0, 0.0)]), ("c", [square(4.0, 0.0)]), ("c", [square(6.0, 0.0)])], SHAPE.replace("id", "HUC_12"))
    gages = spark.createDataFrame([("g1", "x", 0.5, 0.5), ("g1", "x", 0.5, 0.5), ("g2", "y", 0.5, 4.5), ("g3", "z", 0.5, 4.5), (None, "w", 0.5, 0.5), ("g5", "v", 9.0, 9.0)], "SiteNum string, SiteName string, Lat double, Lon double")
    sites = spark.createDataFrame(
        [("s1", 0.5, 0.5, "in"), ("s1", 0.5, 0.5, "in"), ("s2", 2.5, 0.5, "in"), ("s3", 6.5, 0.5, "in"), ("s4", 0.5, 0.5, "out"), ("s5", 0.5, 0.5, None), (None, 0.5, 0.5, "in")],
        "masterid string, longitude double, latitude double, county string")
    return gages, sites, shapes, spark.createDataFrame([("in",), ("in",)], "NAME_PCASE string")


def test_only_sites_that_can_have_a_pair_are_tagged(spark, monkeypatch):
    """Counties are asked before the tagging, and watersheds without a gage are left out of it (F2)."""
    seen = []

    def tag(points, polygons, *args):
        seen.append((points.count(), {r.HUC_12 for r in polygons.collect()}))
        return G.point_in_polygon(points, polygons, *args)

    monkeypatch.setattr(watersheds, "point_in_polygon", tag)
    pairs = watersheds.site_gage_pairs(*crossed_tables(spark))
    assert pairs.columns == ["SiteNum", "SiteName", "Lat", "Lon", "HUC_12", "masterid", "longitude", "latitude", "county"]
    assert sorted((str(r.SiteNum), r.masterid, r.HUC_12) for r in pairs.collect()) == [("None", "s1", "a"), ("g1", "s1", "a"), ("g2", "s3", "c"), ("g3", "s3", "c")]
    assert seen == [(5, {"a", "c"}), (3, {"a", "c"})]


def test_watersheds_in_use_pair_what_is_asked(spark, monkeypatch):
    """Pairs of which only the watershed is asked are one a watershed, not one for each site and gage (F3)."""
    made = []

    def pair(left, right, key):
        made.append(J.pair_by_key(left, right, key))
        return made[-1]

    monkeypatch.setattr(watersheds, "pair_by_key", pair)
    gages, sites, shapes, counties = crossed_tables(spark)
    short = watersheds.site_gage_pairs(gages, sites, shapes, counties, ["HUC_12"])
    assert sorted(r.HUC_12 for r in short.collect()) == ["a", "c"] and made[0].count() == 2
    named = watersheds.site_gage_pairs(gages, sites, shapes, counties, ["HUC_12", "masterid"])
    assert sorted(tuple(r) for r in named.collect()) == [("a", "s1"), ("c", "s3")]
    assert sorted(r.HUC_12 for r in watersheds.watersheds_in_use(shapes, short).collect()) == ["a", "c", "c"]


def test_albers_origin_and_round_trip(spark):
    points = spark.createDataFrame([(-120.0, 0.0), (-118.25, 34.05), (-124.3, 41.9)], "lon double, lat double")
    x, y = G.to_albers(F.col("lon"), F.col("lat"))
    flat = points.withColumns({"x": x, "y": y})
    lon, lat = G.from_albers(F.col("x"), F.col("y"))
    rows = flat.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert (rows[0].x, rows[0].y) == (pytest.approx(0, abs=1e-6), pytest.approx(-4_000_000, abs=1e-3))
    for r in rows:
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))


def test_upstream(spark):
    edges = [(2, 1, 4.0), (3, 1, 1.0), (4, 2, 5.0), (5, 4, 3.0), (6, 3, 8.5), (7, 7, 1.0), (8, 6, 0.5), (20, 21, 2.0)]
    reaches = spark.createDataFrame(edges, "comid long, to_comid long, length_km double")
    origins = spark.createDataFrame([(1,), (3,), (99,)], "comid long")
    got = {(r.comid_origin, r.comid): r.km for r in rivers.upstream(reaches, origins).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 4.0, (1, 3): 1.0, (1, 4): 9.0, (1, 6): 9.5, (1, 8): 10.0, (3, 3): 0.0, (3, 6): 8.5, (3, 8): 9.0, (99, 99): 0.0}
    sizes = {r.has_upstream: r.n for r in rivers.walk_size(rivers.upstream(reaches, origins)).collect()}
    assert sizes == {True: 2, False: 1}


def test_mainstem_takes_the_heaviest_inflow(spark):
    reaches = spark.createDataFrame([(2, 1, 1.0, 5.0), (3, 1, 1.0, 9.0), (4, 3, 1.0, 1.0), (5, 3, 1.0, 1.0)], "comid long, to_comid long, length_km double, w double")
    assert {(r.comid, r.to_comid) for r in rivers.mainstem(reaches, "w").collect()} == {(3, 1), (4, 3)}


def test_long_river_with_a_loop(spark):
    chain = [(i + 1, i, 0.1) for i in range(1, 300)] + [(1, 50, 0.1)]
    walk = rivers.upstream(spark.createDataFrame(chain, "comid long, to_comid long, length_km double"), spark.createDataFrame([(1,)], "comid long"), 5.05)
    assert walk.count() == 51
