"""Geometry, augmentation and mosaics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropseries.operators import augment, raster
from cropseries.sources import rasters


def image(spark, h, w, tile=1, seed=0):
    a = np.random.default_rng(seed).random((h, w)) + 0.1
    return a, spark.createDataFrame([(tile, y, x, float(a[y, x])) for y in range(h) for x in range(w)], "tile_id int, y int, x int, v double")


def array(df, h, w, column="v"):
    a = np.full((h, w), np.nan)
    for r in df.collect():
        a[r.y, r.x] = r[column] if r[column] is not None else np.nan
    return a


@pytest.mark.parametrize("size,starts", [(48, [0]), (96, [0, 48]), (100, [0, 48, 96])])
def test_window_starts(size, starts):
    assert raster.start_points(size, 48) == starts


@pytest.mark.parametrize("h,w,tw,th,overlap", [(10, 13, 4, 5, 0.0), (10, 13, 6, 6, 0.5), (5, 5, 8, 8, 0.0), (9, 20, 7, 4, 0.25)])
def test_tiling_matches_explicit_windows(spark, h, w, tw, th, overlap):
    _, df = image(spark, h, w)
    got = {(r.row_off, r.col_off, r.y, r.x) for r in raster.tile_pixels(df, h, w, tw, th, overlap=overlap).collect()}
    want = {(r, c, y, x) for c in raster.start_points(w, tw, overlap) for r in raster.start_points(h, th, overlap)
            for y in range(r, min(r + th, h)) for x in range(c, min(c + tw, w))}
    assert got == want
    assert {(y, x) for _, _, y, x in got} == {(y, x) for y in range(h) for x in range(w)}


@pytest.mark.parametrize("h,w,size", [(7, 9, 4), (3, 9, 4), (4, 4, 4)])
def test_crop_pad(spark, h, w, size):
    a, df = image(spark, h, w)
    oy, ox = max(0, (h - size) // 2), max(0, (w - size) // 2)
    want = np.zeros((size, size))
    part = a[oy:oy + size, ox:ox + size]
    want[:part.shape[0], :part.shape[1]] = part
    assert np.allclose(array(raster.crop_pad(df, ["tile_id"], ["v"], size, h, w), size, size), want)


def test_flip_twice_is_the_image(spark, rows):
    a, df = image(spark, 4, 5)
    for code, want in ((0, a[::-1]), (1, a[:, ::-1]), (-1, a[::-1, ::-1])):
        once = augment.flip(df, code, 4, 5)
        assert np.allclose(array(once, 4, 5), want)
        assert rows(augment.flip(once, code, 4, 5)) == rows(df)


def test_affine_remap_matches_loop(spark):
    a, df = image(spark, 8, 9)
    out = array(augment.affine_remap(df, ["tile_id"], ["v"], 8, 9, shift=(1, -2), angle=40.0, zoom=0.2), 8, 9)
    c, s = math.cos(math.radians(40)), math.sin(math.radians(40))
    want = np.zeros((8, 9))
    for y in range(8):
        for x in range(9):
            u, v = (x + 1 - 4) / 1.2, (y - 2 - 4) / 1.2
            sx, sy = math.floor(u * c - v * s + 4.5), math.floor(u * s + v * c + 4.5)
            if 0 <= sx < 9 and 0 <= sy < 8:
                want[y, x] = a[sy, sx]
    assert np.allclose(out, want)
    assert np.allclose(array(augment.affine_remap(df, ["tile_id"], ["v"], 8, 9), 8, 9), a)


def test_sobel(spark):
    a, df = image(spark, 6, 5)
    out = raster.sobel(df, ["tile_id"], "v")
    p = np.pad(a, 1)
    k = np.array([[1, 0, -1], [2, 0, -2], [1, 0, -1]])
    for column, kernel in (("sobel_x", k), ("sobel_y", k.T)):
        want = np.array([[(p[y:y + 3, x:x + 3] * kernel).sum() for x in range(5)] for y in range(6)])
        assert np.allclose(array(out, 6, 5, column), want)


def test_hist_equalize(spark):
    values = np.random.default_rng(3).integers(0, 256, (8, 8))
    df = spark.createDataFrame([(1, y, x, int(values[y, x])) for y in range(8) for x in range(8)], "tile_id int, y int, x int, v int")
    cdf = np.bincount(values.ravel(), minlength=256).cumsum().astype(float)
    low = cdf[cdf > 0].min()
    want = np.floor((cdf - low) * 255 / (cdf.max() - low)).clip(0).astype(int)[values]
    assert (array(raster.hist_equalize(df, ["tile_id"], "v"), 8, 8, "equalized") == want).all()


def test_cut_patches_pad_to_full_size(spark):
    a, df = image(spark, 5, 7)
    out = raster.cut_patches(df, ["tile_id"], ["v"], 4, 5, 7)
    assert out.count() == 4 * 16
    got = array(out.filter("patch = 3"), 4, 4)
    want = np.zeros((4, 4))
    want[:1, :3] = a[4:, 4:]
    assert np.allclose(got, want)


def test_clip_polygon(spark, rows):
    square = [(1.5, 1.5), (4.5, 1.5), (4.5, 3.5), (1.5, 3.5), (1.5, 1.5)]
    polygons = spark.createDataFrame([(7, square)], "polygon_id int, ring array<struct<x:double,y:double>>")
    _, df = image(spark, 8, 8)
    got = rows(raster.clip_polygon(df, polygons, 2.0), "y", "x", "polygon_id")
    assert got == [(y, x, 7) for y in (2, 3) for x in (2, 3, 4)]
    assert raster.clip_polygon(df, polygons, 2.0, buffer=0.6).count() > len(got)


def test_border_and_reduction(spark):
    a, df = image(spark, 10, 10)
    assert np.isnan(array(raster.border_na(df, ["v"], 20, 10, 10), 10, 10)).sum() == 100 - 36
    assert raster.centre_reduction(df, 0.2, 10, 10).count() == 64
    assert raster.clip_bbox(df, 2, 2, 4, 4, padding=2, height=10, width=10).count() == 16
    assert raster.clip_bbox(df, 0, 0, 4, 4, padding=2, height=10, width=10).count() == 25


def test_mosaic_conflicts(spark, rows):
    a = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.1)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.2)], "k int, v double")
    assert rows(rasters.mosaic([a, b.filter("k < 3")], ["k"], ["v"])) == [(1, 0.5), (2, 0.7), (3, 0.1)]
    assert rows(rasters.mosaic_conflicts([a, b], ["k"], ["v"])) == [(3,)]
    assert rows(rasters.mosaic([a, b], ["k"], ["v"], "drop")) == [(1, 0.5), (2, 0.7)]
    with pytest.raises(Exception, match="conflicting values"):
        rasters.mosaic([a, b], ["k"], ["v"]).collect()


def cube(spark, patches=6, steps=10, side=8):
    return spark.createDataFrame([(p, t, y, x, 0.0 if t == 0 else 0.5 + p) for p in range(patches) for t in range(steps)
                                  for y in range(side) for x in range(side)], "patch int, t int, y int, x int, v double")


def test_mask_times(spark):
    df = cube(spark)
    out = augment.mask_times(df, ["patch"], "t", ["v"], seed=5)
    assert out.count() == df.count()
    for r in out.filter("t > 0").groupBy("patch").agg((F.sum((F.col("v") == 0).cast("int")) / 64).alias("n")).collect():
        assert r.n == int(r.n) and r.n <= 4
    empty = df.withColumn("v", F.when(F.col("t") < 4, 0.0).otherwise(F.col("v")))
    kept = augment.mask_times(empty, ["patch"], "t", ["v"], seed=5)
    assert kept.filter("v = 0").count() == empty.filter("v = 0").count()


def test_mask_blocks_stay_under_the_share(spark):
    df = cube(spark, 4, 20, 16).withColumn("v", F.lit(1.0))
    out = augment.mask_blocks(df, ["patch", "t"], ["v"], 16, 16, seed=3)
    shares = [r.s for r in out.groupBy("patch", "t").agg(F.avg((F.col("v") == 0).cast("double")).alias("s")).collect()]
    assert out.count() == df.count() and max(shares) <= 0.15 and sum(s > 0 for s in shares) > 20
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, augment.mask_blocks(df.repartition(3), ["patch", "t"], ["v"], 16, 16, seed=3).collect()))


def test_noise(spark):
    df = cube(spark)
    ids = ["patch", "t", "y", "x"]
    noisy = augment.add_noise(df, ["patch", "t"], ids, ["v"], seed=1)
    assert noisy.filter("t = 0 AND v <> 0").count() == 0
    diff = noisy.alias("a").join(df.alias("b"), ids).filter("t > 0").agg(
        F.avg(F.col("a.v") - F.col("b.v")).alias("m"), F.stddev(F.col("a.v") - F.col("b.v")).alias("s")).first()
    assert abs(diff.m) < 0.005 and 0.01 <= diff.s <= 0.05
    speckle = augment.add_noise(df, ["patch", "t"], ids, ["v"], seed=1, mode="speckle", std=(0.0, 2.0))
    assert speckle.filter("v < 0").count() == 0 and speckle.filter("t = 0 AND v <> 0").count() == 0


def test_cutmix_copies_one_rectangle_from_the_partner(spark):
    df = cube(spark, 30, 2, 8).withColumn("label", F.col("patch") * 10)
    out = augment.cutmix(df.filter("t = 1").drop("t"), "patch", ["v", "label"], seed=11, height=8, width=8)
    pairs = {r.patch: r for r in augment.cutmix_partners(df, "patch", 11, 8, 8).collect()}
    assert sorted(r.partner for r in pairs.values()) == list(range(30))
    assert out.count() == 30 * 64
    for r in out.collect():
        q = pairs[r.patch]
        source = q.partner if q.x1 <= r.x < q.x2 and q.y1 <= r.y < q.y2 else r.patch
        assert (r.v, r.label) == (0.5 + source, source * 10)


def test_align_nearest_loses_no_cell(spark):
    sources = spark.createDataFrame([(1, 2 * i, 2 * j, float(10 * j + i)) for i in range(4) for j in range(3)], "tile_id int, x int, y int, v double")
    got = {(r.row, r.col): r.v for r in raster.align_nearest(sources, ["tile_id"], ["v"], 0.0, 0.0, 1.0, 5, 7).collect()}
    near = lambda k: k // 2  # a cell between two sources takes the lower
    assert got == {(r, c): 10.0 * near(r) + near(c) for r in range(5) for c in range(7)}


def test_align_nearest_matches_loop(spark):
    rng = np.random.default_rng(3)
    images = {1: (np.sort(rng.uniform(0, 20, 9)), np.sort(rng.uniform(0, 20, 6))), None: (np.array([3.0, 4.5, 4.75]), np.array([2.0])), 2: (np.arange(0, 20, 0.3), np.arange(5, 9, 0.3))}
    rows = [(k, float(x), float(y), float(i * 1000 + j)) for k, (xs, ys) in images.items() for i, x in enumerate(xs) for j, y in enumerate(ys) if (i + j) % 5]
    df = spark.createDataFrame(rows + [(1, None, 1.0, -1.0), (1, 1.0, None, -1.0)], "tile_id int, x double, y double, v double")
    got = sorted(((r.tile_id, r.row, r.col, r.v) for r in raster.align_nearest(df, ["tile_id"], ["v"], -1.0, 0.5, 0.7, 40, 25).collect()), key=str)
    want = []
    for k in images:
        own = [r for r in rows if r[0] == k]
        xs, ys, values = sorted({r[1] for r in own}), sorted({r[2] for r in own}), {(r[1], r[2]): r[3] for r in own}
        for row in range(40):
            for col in range(25):
                x, y = -1.0 + col * 0.7, 0.5 + row * 0.7
                if xs[0] - 1e-9 <= x <= xs[-1] + 1e-9 and ys[0] - 1e-9 <= y <= ys[-1] + 1e-9:
                    v = values.get((min(xs, key=lambda a: (round(abs(a - x), 8), a)), min(ys, key=lambda a: (round(abs(a - y), 8), a))))
                    if v is not None:
                        want.append((k, row, col, v))
    assert (set(got) - set(want), set(want) - set(got), len(got)) == (set(), set(), len(want)) and len(want) > 300
    assert raster.align_nearest(df.limit(0), ["tile_id"], ["v"], 0.0, 0.0, 1.0, 4, 4).count() == 0


def test_rectangles_are_drawn_once_for_each_step(spark, rows, monkeypatch):
    df = spark.range(16 * 16 * 6).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("patch"), (F.floor("id") % 2).alias("t"), F.lit(1.0).alias("v"),
                                         F.floor(F.col("id") / 6 % 16).cast("int").alias("y"), F.floor(F.col("id") / 96).cast("int").alias("x"))
    draw, met = augment.block_rectangles, []
    each = draw(df, ["patch", "t"], 16, 16, 3, 0.15, 2)
    hit = " OR ".join(f"COALESCE(y >= _y1_{i} AND y < _y1_{i} + _h_{i} AND x >= _x1_{i} AND x < _x1_{i} + _w_{i}, false)" for i in range(2))
    want = rows(each.withColumn("v", F.expr(f"CASE WHEN {hit} THEN 0.0 ELSE v END")), *df.columns)
    monkeypatch.setattr(augment, "block_rectangles", lambda steps, *rest: met.append(steps.count()) or draw(steps, *rest))
    assert rows(augment.mask_blocks(df, ["patch", "t"], ["v"], 16, 16, 3, n_blocks=2), *df.columns) == want
    assert met == [6] and any(r[2] == 0.0 for r in want)
