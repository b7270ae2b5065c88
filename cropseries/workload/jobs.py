"""Composed phenology jobs, clustering, scoring, splits and seeded augmentations.

The iterative ones have no SQL form; the tests check them against NumPy or straight loops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import augment, clustering, matching, phenology, scoring, splits
from ..plans import calendar_maps, tile_store
from ..session import scratch_path
from .catalog import references
from .composites import smooth_curves
from .registry import day, drawn, drawn_unit, hash_rank, query, r6

IMAGE = ["tile_id", "y", "x"]


def _end(t):
    return t.px_series.agg(F.max("obs_date").alias("d")).scalar()


@query("smfs_fit")
def smfs_fit(t):
    """Stage days of every pixel, month window and stage of its nearest reference."""
    matched = matching.nearest_reference(smooth_curves(t), ["pixel_id", "window_end"], references(t), 0.9, ["ref_vi", "phen_days"])
    stages = matched.select("pixel_id", "window_end", "ref_id", "vi", "ref_vi", F.posexplode("phen_days").alias("position", "p0"))
    return phenology.smfs_fit(stages)


@query("phenology_pixels")
def phenology_pixels(t):
    return calendar_maps.phenology_pixels(t.px_series, t.class_map, references(t), _end(t), 1200, threshold=0.9)


def _clusters(t):
    """Clusters of the pixels from their mean band values."""
    means = t.px_series.groupBy(*IMAGE).agg(*[F.avg(b).alias(b) for b in ("blue", "green", "red", "nir")])
    features = means.select(*IMAGE, F.array("blue", "green", "red", "nir").alias("features"))
    return clustering.token_clusters_by_tile(features, ["tile_id"], IMAGE, 8, 4, tolerance=1e-4).select(*IMAGE, "cluster_id")


@query("phenology_clusters")
def phenology_clusters(t):
    return calendar_maps.phenology_clusters(t.px_series, t.class_map, _clusters(t), references(t), _end(t), 1200,
                                            reference_threshold=0.9, pixel_threshold=0.9)


@query("token_reduce")
def token_reduce(t):
    reduced = clustering.token_reduce(t.tokens.select("vec_id", "tile_id", "embedding"))
    return reduced.select("vec_id", "tile_id", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("token_clusters")
def token_clusters(t):
    reduced = clustering.token_reduce(t.tokens.select("vec_id", "tile_id", "embedding"))
    return clustering.token_clusters(reduced, 6).select("vec_id", "tile_id", "cluster_id")


_WEIGHTS = "[" + ", ".join("[" + ", ".join(f"{w!r}" for w in map(float, row)) + "]" for row in np.cos(np.outer(np.arange(64), np.arange(1, 8))).T) + "]"


@query("token_clusters_by_tile")
def token_clusters_by_tile(t):
    reduced = clustering.token_reduce(t.tokens.select("vec_id", "tile_id", "embedding"))
    return clustering.token_clusters_by_tile(reduced, ["tile_id"], ["vec_id"], 6, 2, tolerance=1e-4).select("vec_id", "tile_id", "cluster_id")


@query("score_batches", f"""
    WITH w AS (SELECT UNNEST({_WEIGHTS}) AS weight, UNNEST(RANGE(0, 7)) AS class),
         s AS (SELECT vec_id, class, LIST_DOT_PRODUCT(CAST(embedding AS DOUBLE[]), weight) AS score FROM $tokens, w)
    SELECT vec_id, CAST(ARG_MAX(class, score) AS INT) AS class, CAST(NULL AS VARCHAR) AS error, {r6('MAX(score)', 'top_score')}
    FROM s GROUP BY vec_id""")
def score_batches(t):
    """Seven class scores per token from a fixed linear model."""
    weights = np.cos(np.outer(np.arange(64), np.arange(1, 8)))
    return scoring.score_batches(t.tokens.select("vec_id", "embedding"), lambda m, w: m @ w, "embedding", ["vec_id"], weights) \
        .select("vec_id", "class", "error", F.array_max("scores").alias("top_score"))


@query("token_clusters_restarted")
def token_clusters_restarted(t):
    reduced = clustering.token_reduce(t.tokens.select("vec_id", "tile_id", "embedding"))
    return clustering.token_clusters_restarted(reduced, ["tile_id"], ["vec_id"], 6, 2, tolerance=1e-4).select("vec_id", "tile_id", "cluster_id", "inertia")


@query("split_by_tile", f"""
    WITH t AS (SELECT DISTINCT l_suppkey AS tile_id FROM lineitem),
         r AS (SELECT tile_id, {hash_rank(123, 'tile_id')} AS k, COUNT(*) OVER () AS n FROM t)
    SELECT l_orderkey, l_linenumber, tile_id, CASE WHEN k <= FLOOR(n * 0.15) THEN 'validation' ELSE 'training' END AS split
    FROM lineitem JOIN r ON l_suppkey = tile_id""")
def split_by_tile(t):
    return splits.split_by_tile(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("tile_id")))


@query("random_split", f"""
    SELECT o_orderkey, CASE WHEN k <= GREATEST(1, FLOOR(n * 0.15)) THEN 'validation' ELSE 'training' END AS split
    FROM (SELECT o_orderkey, {hash_rank(42, 'o_orderkey')} AS k, COUNT(*) OVER () AS n FROM orders)""")
def random_split(t):
    return splits.random_split(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("subset", f"""
    SELECT o_orderkey FROM (SELECT o_orderkey, {hash_rank(42, 'o_orderkey')} AS k, COUNT(*) OVER () AS n FROM orders)
    WHERE k <= FLOOR(n * 0.15)""")
def subset(t):
    return splits.subset(t.orders.select("o_orderkey"), ["o_orderkey"])


@query("mask_times", f"""
    WITH s AS (SELECT pixel_id, obs_date, BOOL_OR(COALESCE(nir, 0) <> 0) AS used FROM $px_series GROUP BY 1, 2),
         r AS (SELECT pixel_id, obs_date, ROW_NUMBER() OVER (PARTITION BY pixel_id ORDER BY {drawn(42, 'pixel_id', 'obs_date')}, obs_date) AS k,
                      COUNT(*) OVER (PARTITION BY pixel_id) AS n, AVG(CAST(NOT used AS INT)) OVER (PARTITION BY pixel_id) AS empty,
                      {drawn(43, 'pixel_id')} % 41 AS percent FROM s),
         m AS (SELECT pixel_id, obs_date, empty < 0.4 AND k <= FLOOR(n * percent / 100.0) AS hit FROM r)
    SELECT pixel_id, {day('obs_date', 'obs_date')}, {r6('CASE WHEN hit THEN 0 ELSE nir END', 'nir')}, {r6('CASE WHEN hit THEN 0 ELSE green END', 'green')}
    FROM $px_series JOIN m USING (pixel_id, obs_date)""")
def mask_times(t):
    return augment.mask_times(t.px_series.select("pixel_id", "obs_date", "nir", "green"), ["pixel_id"], "obs_date", ["nir", "green"], seed=42)


def _blocks_sql(ids, seed=42, size=48, share=0.15, n=4):
    """The rectangles of ``block_rectangles`` step by step."""
    seeds = lambda i: seed * 1009 + i
    sql = f"b AS (SELECT {ids}, {drawn_unit(seed, ids)} * {share} * {size * size} AS budget, " + ", ".join(
        f"{drawn_unit(seeds(500_009 + i), ids)} + 0.1 AS u{i}" for i in range(n)) + " FROM steps)"
    total = " + ".join(f"u{i}" for i in range(n))
    sql += ", a AS (SELECT *, " + ", ".join(f"budget * u{i} / ({total}) AS a{i}" for i in range(n)) + ", 0 AS spent, CAST(0 AS DOUBLE) AS due FROM b)"
    before = "a"
    for i in range(n):
        aspect = f"EXP(({drawn_unit(seeds(i * 3), ids)} * 2 - 1) * LN(1 / 0.3))"
        sql += f""", l{i} AS (SELECT * EXCLUDE due, due + a{i} AS due, due + a{i} - spent AS l FROM {before}),
            h{i} AS (SELECT *, CASE WHEN l >= 1 THEN CAST(LEAST(GREATEST(ROUND(SQRT(l * {aspect})), 1), {size}, FLOOR(l)) AS INT) END AS h_{i} FROM l{i}),
            w{i} AS (SELECT *, CAST(LEAST(FLOOR(l / h_{i}), {size}) AS INT) AS w_{i} FROM h{i}),
            c{i} AS (SELECT * EXCLUDE (spent, l), spent + COALESCE(h_{i} * w_{i}, 0) AS spent,
                            CAST(FLOOR({drawn_unit(seeds(i * 3 + 1), ids)} * ({size + 1} - h_{i})) AS INT) AS y_{i},
                            CAST(FLOOR({drawn_unit(seeds(i * 3 + 2), ids)} * ({size + 1} - w_{i})) AS INT) AS x_{i} FROM w{i})"""
        before = f"c{i}"
    hit = " OR ".join(f"COALESCE(y >= y_{i} AND y < y_{i} + h_{i} AND x >= x_{i} AND x < x_{i} + w_{i}, false)" for i in range(n))
    return sql, before, hit


_RECTANGLES, _LAST, _HIT = _blocks_sql("tile_id, obs_date")


@query("mask_blocks", f"""
    WITH steps AS (SELECT DISTINCT tile_id, obs_date FROM $px_raster), {_RECTANGLES}
    SELECT tile_id, y, x, {day('obs_date', 'obs_date')}, {r6('green', 'green')}, {r6(f'CASE WHEN {_HIT} THEN 0 ELSE red END', 'red')},
           {r6(f'CASE WHEN {_HIT} THEN 0 ELSE nir END', 'nir')}
    FROM $px_raster JOIN {_LAST} USING (tile_id, obs_date)""")
def mask_blocks(t):
    return augment.mask_blocks(t.px_raster, ["tile_id", "obs_date"], ["nir", "red"], 48, 48, seed=42)


def _normal_sql(seed, ids):
    return f"SQRT(LN(GREATEST({drawn_unit(seed, ids)}, 1e-12)) * -2.0) * COS({drawn_unit(seed + 1, ids)} * (2 * PI()))"


_ROW = "tile_id, y, x, obs_date, green"
_SIGMA = f"({drawn_unit(49, 'tile_id')} * (0.05 - 0.01) + 0.01)"


@query("add_noise", f"""
    WITH s AS (SELECT tile_id, obs_date, BOOL_OR(COALESCE(nir, 0) <> 0) AS used FROM $px_raster GROUP BY 1, 2)
    SELECT tile_id, y, x, {day('obs_date', 'obs_date')}, {r6('green', 'green')},
           {r6(f'CASE WHEN used THEN nir + {_normal_sql(52, _ROW)} * {_SIGMA} ELSE nir END', 'nir')},
           {r6(f'CASE WHEN used THEN red + {_normal_sql(62, _ROW)} * {_SIGMA} ELSE red END', 'red')}
    FROM $px_raster JOIN s USING (tile_id, obs_date)""")
def add_noise(t):
    return augment.add_noise(t.px_raster, ["tile_id", "obs_date"], [*IMAGE, "obs_date", "green"], ["nir", "red"], seed=42)


_PATCHES = "SELECT pixel_id, fmask AS y, CAST(MONTH(obs_date) AS INT) AS x, MAX(nir) AS nir, MIN(green) AS green FROM $px_series GROUP BY 1, 2, 3"


@query("cutmix", f"""
    WITH p AS ({_PATCHES}), ids AS (SELECT DISTINCT pixel_id FROM p),
         b AS (SELECT pixel_id, {drawn(42, 'pixel_id')} % (SELECT GREATEST(1, CAST(CEIL(COUNT(*) / 12) AS BIGINT)) FROM ids) AS batch, {drawn(43, 'pixel_id')} AS h FROM ids),
         q AS (SELECT pixel_id, batch, COALESCE(LEAD(pixel_id) OVER (PARTITION BY batch ORDER BY h, pixel_id),
                      FIRST_VALUE(pixel_id) OVER (PARTITION BY batch ORDER BY h, pixel_id)) AS partner FROM b),
         s AS (SELECT *, FLOOR(SQRT(1.0 - {drawn_unit(44, 'batch')}) * 13 / 2) AS hw, FLOOR(SQRT(1.0 - {drawn_unit(44, 'batch')}) * 65 / 2) AS hh,
                      {drawn_unit(45, 'batch')} * 13 AS cx, {drawn_unit(46, 'batch')} * 65 AS cy FROM q),
         r AS (SELECT pixel_id, partner, GREATEST(0, LEAST(13, FLOOR(cx - hw))) AS x1, GREATEST(0, LEAST(13, FLOOR(cx + hw))) AS x2,
                      GREATEST(0, LEAST(65, FLOOR(cy - hh))) AS y1, GREATEST(0, LEAST(65, FLOOR(cy + hh))) AS y2 FROM s),
         own AS (SELECT p.*, x >= x1 AND x < x2 AND y >= y1 AND y < y2 AS cut FROM p JOIN r USING (pixel_id)),
         given AS (SELECT r.pixel_id, y, x, nir, green FROM p JOIN r ON p.pixel_id = r.partner WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2)
    SELECT pixel_id, y, x, {r6('CASE WHEN g.pixel_id IS NOT NULL THEN g.nir WHEN cut THEN 0 ELSE o.nir END', 'nir')},
           {r6('CASE WHEN g.pixel_id IS NOT NULL THEN g.green WHEN cut THEN 0 ELSE o.green END', 'green')},
           CASE WHEN g.pixel_id IS NOT NULL THEN 'given' WHEN cut THEN 'cut' ELSE 'own' END AS origin
    FROM own o FULL JOIN given g USING (pixel_id, y, x)""")
def cutmix(t):
    patches = t.px_series.groupBy("pixel_id", F.col("fmask").alias("y"), F.month("obs_date").alias("x")).agg(
        F.max("nir").alias("nir"), F.min("green").alias("green"))
    return augment.cutmix(patches, "pixel_id", ["nir", "green"], seed=42, height=65, width=13)


@query("tile_store", f"""
    SELECT l_suppkey AS tile_id, CASE WHEN l_suppkey = 7 THEN 'failed' ELSE 'done' END AS status, CAST(CASE WHEN l_suppkey = 7 THEN 0 ELSE COUNT(DISTINCT l_shipdate) END AS BIGINT) AS n_rows,
           CASE WHEN l_suppkey <> 7 THEN {r6('SUM(l_tax)', 'total').removesuffix(' AS total')} END AS total FROM lineitem GROUP BY l_suppkey""")
def store_of_tiles(t):
    """The daily sums of each supplier as a tile; one tile cannot be read, and a second run finds nothing else to do."""
    path = scratch_path(t.spark, "tile-store")
    source = t.lineitem.select(F.col("l_suppkey").alias("tile_id"), "l_shipdate", "l_tax")
    tiles = source.select("tile_id").distinct()

    def process(chosen, rows):
        daily = rows.join(chosen, "tile_id", "left_semi").groupBy("tile_id", "l_shipdate").agg(F.sum("l_tax").alias("tax"))
        return daily.withColumn("tax", F.when(F.col("tile_id") == 7, F.raise_error(F.lit("no such tile")).cast("double")).otherwise(F.col("tax")))
    for _ in range(2):
        done = tile_store.run_tiles(tiles, process, path, batch=2000, retry_failed=False, source=source)
    totals = tile_store.finished(t.spark, path).groupBy("tile_id").agg(F.sum("tax").alias("total"))
    return done.select("tile_id", "status", "n_rows").join(totals.withColumn("tile_id", F.col("tile_id").cast("bigint")), "tile_id", "left")
