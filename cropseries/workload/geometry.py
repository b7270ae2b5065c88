"""Raster geometry operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import augment, patches, quadtree, raster
from .registry import drawn, drawn_unit, query, r6

TILE = ["tile_id"]
GRID = lambda h, w: f"(SELECT tile_id, CAST(y AS INT) AS y, CAST(UNNEST(RANGE(0, {w})) AS INT) AS x FROM (SELECT tile_id, UNNEST(RANGE(0, {h})) AS y FROM (SELECT DISTINCT tile_id FROM $px_image)))"


@query("crop_pad", f"""
    SELECT g.tile_id, g.y, g.x, {r6('COALESCE(p.nir, 0)', 'nir')}, {r6('COALESCE(p.red, 0)', 'red')}
    FROM {GRID(32, 32)} g LEFT JOIN $px_image p ON p.tile_id = g.tile_id AND p.y = g.y + 8 AND p.x = g.x + 8""")
def crop_pad(t):
    return raster.crop_pad(t.px_image, TILE, ["nir", "red"], 32, 48, 48)


@query("crop_pad_grow", f"""
    SELECT g.tile_id, g.y, g.x, {r6('COALESCE(p.nir, 0)', 'nir')} FROM {GRID(64, 64)} g LEFT JOIN $px_image p USING (tile_id, y, x)""")
def crop_pad_grow(t):
    return raster.crop_pad(t.px_image, TILE, ["nir"], 64, 48, 48)


@query("orient_y", f"""
    SELECT tile_id, CAST(47 - y AS INT) AS y, x, {r6('nir', 'nir')} FROM $px_image""")
def orient_y(t):
    return raster.orient_y(t.px_image, 48).select("tile_id", "y", "x", "nir")


@query("clip_bbox", f"SELECT tile_id, y, x, {r6('nir', 'nir')} FROM $px_image WHERE x >= 9 AND x < 31 AND y >= 0 AND y < 42")
def clip_bbox(t):
    return raster.clip_bbox(t.px_image, 10, 0, 30, 41, padding=2, height=48, width=48).select("tile_id", "y", "x", "nir")


# one triangle per nation, its corners off the pixel centres
_X, _Y = "(n_nationkey % 5 * 9 + 0.37)", "(FLOOR(n_nationkey / 5) * 9 + 0.41)"
_SIDE = lambda ax, ay, bx, by: f"(({bx} - {ax}) * (y - {ay}) - ({by} - {ay}) * (x - {ax}) > 0)"


@query("clip_polygon", f"""
    SELECT tile_id, y, x, n_nationkey AS polygon_id
    FROM $px_image, (SELECT n_nationkey, CAST({_X} AS DOUBLE) AS px, CAST({_Y} AS DOUBLE) AS py FROM nation)
    WHERE {_SIDE('px', 'py', '(px + 20)', '(py + 5)')} AND {_SIDE('(px + 20)', '(py + 5)', '(px + 5)', '(py + 20)')}
      AND {_SIDE('(px + 5)', '(py + 20)', 'px', 'py')}""")
def clip_polygon(t):
    px, py = (F.col("n_nationkey") % 5 * 9 + F.lit(0.37)).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 9 + F.lit(0.41)).cast("double")
    corner = lambda dx, dy: F.struct((px + dx).alias("x"), (py + dy).alias("y"))
    polygons = t.nation.select(F.col("n_nationkey").alias("polygon_id"),
                               F.array(corner(0, 0), corner(20, 5), corner(5, 20), corner(0, 0)).alias("ring"))
    return raster.clip_polygon(t.px_image, polygons, cell=16.0).select("tile_id", "y", "x", "polygon_id")


# of each nation a square with a triangular hole and a second part, as edges relative to a corner
_RINGS = [[(0, 0), (20, 5), (17, 22), (3, 18)], [(5, 6), (12, 8), (8, 14)], [(22, 23), (28.2, 24), (23.4, 28.6)]]
_EDGES = ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for ring in _RINGS for a, b in zip(ring, ring[1:] + ring[:1]))
_TURN = lambda dx, dy: f"((x2 - x1) * (y + ({dy}) - y1) - (y2 - y1) * (x + ({dx}) - x1))"
_TURNS = ", ".join(_TURN(dx, dy) for dx in (-0.5, 0.5) for dy in (-0.5, 0.5))


@query("clip_polygons_touched", f"""
    WITH e AS (SELECT n_nationkey AS polygon_id, px + a AS x1, py + b AS y1, px + c AS x2, py + d AS y2
               FROM (SELECT n_nationkey, CAST({_X} AS DOUBLE) AS px, CAST({_Y} AS DOUBLE) AS py FROM nation), (VALUES {_EDGES}) AS v(a, b, c, d)),
         t AS (SELECT tile_id, y, x, polygon_id,
                      BOOL_OR(GREATEST(x1, x2) >= x - 0.5 AND LEAST(x1, x2) < x + 0.5 AND GREATEST(y1, y2) >= y - 0.5 AND LEAST(y1, y2) < y + 0.5
                              AND LEAST({_TURNS}) <= 0 AND GREATEST({_TURNS}) >= 0) AS met,
                      SUM(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1 AS inside
               FROM $px_image, e GROUP BY 1, 2, 3, 4)
    SELECT tile_id, y, x, polygon_id FROM t WHERE met OR inside""")
def clip_polygons_touched(t):
    """Polygons of several rings; every pixel that they touch counts."""
    px, py = (F.col("n_nationkey") % 5 * 9 + F.lit(0.37)).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 9 + F.lit(0.41)).cast("double")
    rings = F.array(*[F.array(*[F.struct((px + a).alias("x"), (py + b).alias("y")) for a, b in [*ring, ring[0]]]) for ring in _RINGS])
    polygons = t.nation.select(F.col("n_nationkey").alias("polygon_id"), rings.alias("rings"))
    return quadtree.clip_polygons(t.px_image, polygons, 48, 48).select("tile_id", "y", "x", "polygon_id")


@query("border_na", f"""
    SELECT tile_id, y, x, {r6('CASE WHEN x BETWEEN 7 AND 40 AND y BETWEEN 7 AND 40 THEN nir END', 'nir')} FROM $px_image""")
def border_na(t):
    return raster.border_na(t.px_image, ["nir"], 15, 48, 48).select("tile_id", "y", "x", "nir")


@query("centre_reduction", f"""
    SELECT tile_id, y, x, {r6('nir', 'nir')} FROM $px_image WHERE x BETWEEN 5 AND 42 AND y BETWEEN 5 AND 42""")
def centre_reduction(t):
    return raster.centre_reduction(t.px_image, 0.2, 48, 48).select("tile_id", "y", "x", "nir")


@query("label_join", f"""
    SELECT r.tile_id, r.y, r.x, {r6('r.nir', 'nir')}, COALESCE(l.label, 0) AS label
    FROM $px_raster r LEFT JOIN (SELECT * FROM $px_image WHERE label >= 45) l USING (tile_id, y, x)""")
def label_join(t):
    labels = t.px_image.filter("label >= 45").select("tile_id", "y", "x", "label")
    return raster.label_join(t.px_raster, labels).select("tile_id", "y", "x", "nir", "label")


@query("align_grid", f"""
    WITH s AS (SELECT tile_id, x * 0.7 AS sx, y * 0.7 AS sy, nir FROM $px_image),
         k AS (SELECT *, CAST(FLOOR((sy - 1) / 2 + 0.5) AS INT) AS row, CAST(FLOOR((sx - 1) / 2 + 0.5) AS INT) AS col FROM s),
         d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tile_id, row, col ORDER BY ROUND(POWER(sx - (col * 2 + 1), 2) + POWER(sy - (row * 2 + 1), 2), 9), sy, sx) AS n FROM k)
    SELECT tile_id, row, col, {r6('nir', 'nir')} FROM d WHERE n = 1""")
def align_grid(t):
    source = t.px_image.select("tile_id", (F.col("x") * 0.7).alias("x"), (F.col("y") * 0.7).alias("y"), "nir")
    return raster.align_grid(source, TILE, ["nir"], 1.0, 1.0, 2.0)


@query("align_nearest", f"""
    WITH s AS (SELECT tile_id, x * 2 AS sx, y * 2 AS sy, nir FROM $px_image),
         xs AS (SELECT tile_id, col, arg_min(sx, (ABS(sx - (col - 3)), sx)) AS sx
                FROM (SELECT DISTINCT tile_id, sx FROM s), (SELECT CAST(UNNEST(RANGE(0, 100)) AS INT) AS col) GROUP BY 1, 2 HAVING MIN(sx) <= col - 3 AND MAX(sx) >= col - 3),
         ys AS (SELECT tile_id, row, arg_min(sy, (ABS(sy - (row + 1)), sy)) AS sy
                FROM (SELECT DISTINCT tile_id, sy FROM s), (SELECT CAST(UNNEST(RANGE(0, 100)) AS INT) AS row) GROUP BY 1, 2 HAVING MIN(sy) <= row + 1 AND MAX(sy) >= row + 1)
    SELECT tile_id, row, col, {r6('nir', 'nir')} FROM s JOIN xs USING (tile_id, sx) JOIN ys USING (tile_id, sy)""")
def align_nearest(t):
    """A grid twice as fine as the scene, shifted and larger."""
    source = t.px_image.select("tile_id", (F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"), "nir")
    return raster.align_nearest(source, TILE, ["nir"], -3.0, 1.0, 1.0, 100, 100)


@query("tile_bounds", """
    SELECT tile_id, MIN(x) AS x1, MAX(x) AS x2, MIN(y) AS y1, MAX(y) AS y2,
           CONCAT('POLYGON ((', MIN(x), ' ', MIN(y), ', ', MAX(x), ' ', MIN(y), ', ', MAX(x), ' ', MAX(y), ', ', MIN(x), ' ', MAX(y), ', ',
                  MIN(x), ' ', MIN(y), '))') AS wkt FROM $px_raster GROUP BY tile_id""")
def tile_bounds(t):
    return raster.tile_bounds(t.px_raster, TILE)


@query("hist_equalize", """
    WITH v AS (SELECT tile_id, y, x, label, COUNT(*) OVER (PARTITION BY tile_id ORDER BY label) AS cdf,
                      COUNT(*) OVER (PARTITION BY tile_id) AS hi FROM $px_image),
         b AS (SELECT *, MIN(cdf) OVER (PARTITION BY tile_id) AS lo FROM v)
    SELECT tile_id, y, x, label, CAST(COALESCE(FLOOR((cdf - lo) * 255 / NULLIF(hi - lo, 0)), 0) AS INT) AS equalized FROM b""")
def hist_equalize(t):
    return raster.hist_equalize(t.px_image.select("tile_id", "y", "x", "label"), TILE, "label")




@query("sobel", f"""
    WITH s AS (SELECT p.tile_id, p.y, p.x,
        MAX(CASE WHEN dy = -1 AND dx = -1 THEN n.nir END) AS a, MAX(CASE WHEN dy = -1 AND dx = 0 THEN n.nir END) AS b, MAX(CASE WHEN dy = -1 AND dx = 1 THEN n.nir END) AS c,
        MAX(CASE WHEN dy = 0 AND dx = -1 THEN n.nir END) AS d, MAX(CASE WHEN dy = 0 AND dx = 1 THEN n.nir END) AS f,
        MAX(CASE WHEN dy = 1 AND dx = -1 THEN n.nir END) AS g, MAX(CASE WHEN dy = 1 AND dx = 0 THEN n.nir END) AS h, MAX(CASE WHEN dy = 1 AND dx = 1 THEN n.nir END) AS i
      FROM $px_image p CROSS JOIN (SELECT UNNEST([-1, 0, 1]) AS dy) CROSS JOIN (SELECT UNNEST([-1, 0, 1]) AS dx)
      LEFT JOIN $px_image n ON n.tile_id = p.tile_id AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY 1, 2, 3),
    z AS (SELECT tile_id, y, x, COALESCE(a, 0) AS a, COALESCE(b, 0) AS b, COALESCE(c, 0) AS c, COALESCE(d, 0) AS d, COALESCE(f, 0) AS f,
                 COALESCE(g, 0) AS g, COALESCE(h, 0) AS h, COALESCE(i, 0) AS i FROM s)
    SELECT tile_id, y, x, {r6('a - c + 2 * d - 2 * f + g - i', 'sobel_x')}, {r6('a + 2 * b + c - g - 2 * h - i', 'sobel_y')} FROM z""")
def sobel(t):
    return raster.sobel(t.px_image, TILE, "nir")


@query("tile_pixels", """
    SELECT tile_id, y, x, CAST(c * 10 AS INT) AS col_off, CAST(r * 10 AS INT) AS row_off, CAST(c * 4 + r AS INT) AS window_index
    FROM $px_image, (SELECT UNNEST(RANGE(0, 4)) AS c), (SELECT UNNEST(RANGE(0, 4)) AS r)
    WHERE x >= c * 10 AND x < c * 10 + 20 AND y >= r * 10 AND y < r * 10 + 20""")
def tile_pixels(t):
    return raster.tile_pixels(t.px_image.select("tile_id", "y", "x"), 48, 48, 20, 20, overlap=0.5)


@query("tile_pixels_grid", """
    SELECT tile_id, y, x, CAST(FLOOR(x / 16) * 16 AS INT) AS col_off, CAST(FLOOR(y / 24) * 24 AS INT) AS row_off,
           CAST(FLOOR(x / 16) * 2 + FLOOR(y / 24) AS INT) AS window_index FROM $px_image""")
def tile_pixels_grid(t):
    return raster.tile_pixels(t.px_image.select("tile_id", "y", "x"), 48, 48, rows=2, cols=3)


@query("cut_patches", f"""
    WITH g AS (SELECT tile_id, CAST(p AS INT) AS patch, CAST(i AS INT) AS y, CAST(UNNEST(RANGE(0, 20)) AS INT) AS x
               FROM (SELECT tile_id, p, UNNEST(RANGE(0, 20)) AS i FROM (SELECT tile_id, UNNEST(RANGE(0, 9)) AS p FROM (SELECT DISTINCT tile_id FROM $px_image))))
    SELECT g.tile_id, g.patch, g.y, g.x, {r6('COALESCE(p.nir, 0)', 'nir')} FROM g LEFT JOIN $px_image p
      ON p.tile_id = g.tile_id AND p.y = FLOOR(g.patch / 3) * 20 + g.y AND p.x = g.patch % 3 * 20 + g.x""")
def cut_patches(t):
    return raster.cut_patches(t.px_image, TILE, ["nir"], 20, 48, 48)


@query("tokens_to_pixels", f"""
    SELECT tile_id, vec_id, CAST(tok_row * 2 + dy AS INT) AS y, CAST(tok_col * 2 + dx AS INT) AS x, label
    FROM $tokens, (SELECT UNNEST([0, 1]) AS dy), (SELECT UNNEST([0, 1]) AS dx)""")
def tokens_to_pixels(t):
    return raster.tokens_to_pixels(t.tokens.select("tile_id", "vec_id", "tok_row", "tok_col", "label")).drop("tok_row", "tok_col")


@query("flip", f"SELECT tile_id, CAST(47 - y AS INT) AS y, CAST(47 - x AS INT) AS x, {r6('nir', 'nir')}, label FROM $px_image")
def flip(t):
    return augment.flip(t.px_image, -1, 48, 48).select("tile_id", "y", "x", "nir", "label")


@query("flip_random", f"""
    WITH c AS (SELECT *, [0, 1, -1, NULL][{drawn(7, 'tile_id')} % 4 + 1] AS code FROM $px_image)
    SELECT tile_id, CAST(CASE WHEN code <= 0 THEN 47 - y ELSE y END AS INT) AS y, CAST(CASE WHEN code <> 0 THEN 47 - x ELSE x END AS INT) AS x,
           {r6('nir', 'nir')}, label FROM c""")
def flip_random(t):
    """Each tile is flipped its own way, or not at all."""
    return augment.flip(t.px_image, augment.draw_one(7, TILE, [0, 1, -1, None]), 48, 48).select("tile_id", "y", "x", "nir", "label")


@query("affine_random", f"""
    WITH d AS (SELECT *, RADIANS({drawn_unit(11, 'tile_id')} * 40 - 20) AS a, {drawn_unit(12, 'tile_id')} * 0.5 AS z,
                      {drawn(13, 'tile_id')} % 9 - 4 AS dx, {drawn(14, 'tile_id')} % 9 - 4 AS dy FROM {GRID(48, 48)}),
         m AS (SELECT *, (x + dx - 24) / (1.0 + z) AS u, (y + dy - 24) / (1.0 + z) AS v FROM d),
         s AS (SELECT tile_id, y, x, CAST(FLOOR(u * COS(a) - v * SIN(a) + 24 + 0.5) AS INT) AS sx, CAST(FLOOR(u * SIN(a) + v * COS(a) + 24 + 0.5) AS INT) AS sy FROM m)
    SELECT s.tile_id, s.y, s.x, {r6('COALESCE(p.nir, 0)', 'nir')}, COALESCE(p.label, 0) AS label
    FROM s LEFT JOIN $px_image p ON p.tile_id = s.tile_id AND p.y = s.sy AND p.x = s.sx""")
def affine_random(t):
    """Each tile is shifted, turned and zoomed by its own draw, image and label alike."""
    step = lambda seed: augment.draw_one(seed, TILE, range(-4, 5))
    return augment.affine_remap(t.px_image, TILE, ["nir", "label"], 48, 48, shift=(step(13), step(14)),
                                angle=augment.draw(11, TILE, -20, 20), zoom=augment.draw(12, TILE, 0, 0.5))


_C, _S = "COS(RADIANS(30))", "SIN(RADIANS(30))"


@query("affine_remap", f"""
    WITH m AS (SELECT tile_id, y, x, (x + 3 - 24) / 1.25e0 AS u, (y - 2 - 24) / 1.25e0 AS v FROM {GRID(48, 48)}),
         s AS (SELECT tile_id, y, x, CAST(FLOOR(u * {_C} - v * {_S} + 24 + 0.5) AS INT) AS sx, CAST(FLOOR(u * {_S} + v * {_C} + 24 + 0.5) AS INT) AS sy FROM m)
    SELECT s.tile_id, s.y, s.x, {r6('COALESCE(p.nir, 0)', 'nir')}, COALESCE(p.label, 0) AS label
    FROM s LEFT JOIN $px_image p ON p.tile_id = s.tile_id AND p.y = s.sy AND p.x = s.sx""")
def affine_remap(t):
    return augment.affine_remap(t.px_image, TILE, ["nir", "label"], 48, 48, shift=(3, -2), angle=30.0, zoom=0.25)


# two slots (even and odd years), two bands, patches of 16 x 16; three classes with a 3 x 3 kernel each
_KERNEL = lambda k, t, c, dy, dx: f"(({k} * 5 + {t} * 3 + {c} * 7 + ({dy}) * 2 + ({dx})) % 11 - 5)"


@query("score_images", f"""
    WITH p AS (SELECT tile_id, y, x, CAST(YEAR(obs_date) % 2 AS INT) AS t, MAX(red) AS red, MAX(nir) AS nir FROM $px_raster GROUP BY 1, 2, 3, 4),
         v AS (SELECT tile_id, y, x, t, 0 AS c, red AS v FROM p UNION ALL SELECT tile_id, y, x, t, 1 AS c, nir AS v FROM p),
         g AS (SELECT tile_id, CAST(y AS INT) AS y, CAST(UNNEST(RANGE(0, 48)) AS INT) AS x FROM (SELECT tile_id, UNNEST(RANGE(0, 48)) AS y FROM (SELECT DISTINCT tile_id FROM $px_raster))),
         n AS (SELECT v.tile_id, v.y + 1 - dy AS y, v.x + 1 - dx AS x, v.y AS sy, v.x AS sx, t, c, dy, dx, v FROM v, (SELECT UNNEST([0, 1, 2]) AS dy), (SELECT UNNEST([0, 1, 2]) AS dx)),
         s AS (SELECT tile_id, y, x, {', '.join(f"SUM(v * {_KERNEL(k, 't', 'c', 'dy', 'dx')}) AS s{k}" for k in range(3))}
               FROM n WHERE FLOOR(y / 16) = FLOOR(sy / 16) AND FLOOR(x / 16) = FLOOR(sx / 16) GROUP BY 1, 2, 3),
         r AS (SELECT tile_id, y, x, {', '.join(r6(f'COALESCE(s{k}, 0)', f's{k}') for k in range(3))} FROM g LEFT JOIN s USING (tile_id, y, x))
    SELECT *, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INT) AS class FROM r""")
def score_images(t):
    """A 3 x 3 convolution over all slots and bands of each patch; a patch doesn't see its neighbours."""
    weights = np.fromfunction(lambda k, t, c, dy, dx: (k * 5 + t * 3 + c * 7 + dy * 2 + dx) % 11 - 5, (3, 2, 2, 3, 3))

    def convolve(tensors, kernel):
        padded = np.pad(tensors, ((0, 0), (0, 0), (0, 0), (1, 1), (1, 1)))
        windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(3, 4))
        return np.round(np.einsum("ntcyxij,ktcij->nkyx", windows, kernel), 6)

    slotted = t.px_raster.withColumn("slot", F.year("obs_date") % 2)
    scored = patches.score_images(slotted, convolve, TILE, ["red", "nir"], 16, 2, 48, 48, weights, dtype="<f8")
    return scored.select("tile_id", "y", "x", *[F.col("scores")[k].alias(f"s{k}") for k in range(3)], "class")
