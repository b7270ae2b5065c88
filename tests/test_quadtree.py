"""Quadtree covers of polygons against tests of every pixel."""

import random

import pytest

from cropseries.operators import quadtree
from pyspark.sql import functions as F

RINGS = "polygon_id int, rings array<array<struct<x:double,y:double>>>"


def closed(points):
    return [(float(a), float(b)) for a, b in [*points, points[0]]]


def edges(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:])]


def inside(x, y, rings):
    odd = False
    for (ax, ay), (bx, by) in edges(rings):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def met(x, y, rings):
    for (ax, ay), (bx, by) in edges(rings):
        if max(ax, bx) >= x - .5 and min(ax, bx) < x + .5 and max(ay, by) >= y - .5 and min(ay, by) < y + .5:
            turns = [(bx - ax) * (y + dy - ay) - (by - ay) * (x + dx - ax) for dx in (-.5, .5) for dy in (-.5, .5)]
            if min(turns) <= 0 <= max(turns):
                return True
    return False


def shapes():
    rnd = random.Random(4)
    near = lambda n: rnd.uniform(0, n)
    random_rings = [(i, [closed([(near(40), near(30)) for _ in range(rnd.randint(3, 7))]) for _ in range(rnd.randint(1, 3))]) for i in range(12)]
    square = closed([(5.2, 4.3), (30.7, 4.3), (30.7, 25.9), (5.2, 25.9)])
    hole = closed([(10.1, 9.2), (20.6, 9.2), (20.6, 20.1), (10.1, 20.1)])
    return random_rings + [(100, [square, hole, closed([(33.3, 1.1), (38.2, 1.3), (36.1, 8.4)])]), (101, [closed([(-20.3, -9.7), (90.2, -30.1), (70.4, 80.6), (-5.1, 70.9)])]),
                           (102, [closed([(7.1, 7.2), (7.3, 7.2), (7.2, 7.4)])]), (103, []), (104, [closed([(200.2, 1.0), (210.1, 1.5), (205.0, 9.9)])])]


@pytest.mark.parametrize("touched", [True, False])
def test_same_as_every_pixel(spark, touched):
    polygons = shapes()
    pixels = spark.range(30 * 40).select((F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"), F.lit("z").alias("lo"))
    odd = spark.createDataFrame([(None, 1, "z"), (50, 1, "z"), (3, -4, "z")], pixels.schema)
    got = quadtree.clip_polygons(pixels.unionByName(odd), spark.createDataFrame(polygons, RINGS), 30, 40, touched)
    assert got.columns == ["x", "y", "lo", "polygon_id"]
    got = sorted((r.polygon_id, r.x, r.y) for r in got.collect())
    want = sorted((p, x, y) for p, rings in polygons for x in range(40) for y in range(30) if inside(x, y, rings) or touched and met(x, y, rings))
    assert got == want and len({p for p, _, _ in got} & {100, 101}) == 2


def test_the_cover_grows_with_the_outline(spark):
    counts = []
    for depth in (6, 7, 8):
        n = 1 << depth
        ring = closed([(0.1 * n, 0.2 * n), (0.9 * n, 0.15 * n), (0.55 * n, 0.85 * n)])
        cover = quadtree.polygon_cover(spark.createDataFrame([(1, [ring])], RINGS), depth).collect()
        area = sum(r.hi - r.lo for r in cover)
        codes = sorted((r.lo, r.hi) for r in cover)
        assert 0.25 * n * n < area < 0.4 * n * n and all(a[1] <= b[0] for a, b in zip(codes, codes[1:]))
        counts.append(len(cover))
    assert counts[2] < 2.3 * counts[1] < 2.3 * 2.3 * counts[0] and counts[2] < 0.1 * (1 << 16)


def test_morton_codes(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(1 << 31), rnd.randrange(1 << 31)) for _ in range(50)] + [(0, 0), (1, 0), (0, 1), ((1 << 31) - 1, (1 << 31) - 1)]
    got = [r.m for r in spark.createDataFrame(pairs, "x long, y long").select(quadtree.morton(F.col("x"), F.col("y")).alias("m")).collect()]
    assert got == [sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(31)) for x, y in pairs]


def test_no_polygons(spark):
    pixels = spark.createDataFrame([(1, 1)], "x int, y int")
    assert quadtree.clip_polygons(pixels, spark.createDataFrame([], RINGS), 4, 4).count() == 0


def test_codes_are_not_computed_for_the_rows_behind_the_pixels(spark):
    raw = spark.range(200).select((F.col("id") % 5).cast("int").alias("x"), (F.col("id") % 4).cast("int").alias("y"))
    pixels = raw.groupBy("x", "y").agg(F.count("*").alias("n"))
    square = [[(0.6, 0.6), (2.4, 0.6), (2.4, 2.4), (0.6, 2.4), (0.6, 0.6)]]
    clipped = quadtree.clip_polygons(pixels, spark.createDataFrame([(1, square)], RINGS), 4, 5)
    plan = clipped._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "shiftleft" in line]
    assert sorted((r.x, r.y, r.n) for r in clipped.collect()) == [(x, y, 10) for x in (1, 2) for y in (1, 2)]
