"""Land-cover map and ingest jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..plans import class_maps, ingest
from .registry import day, query, r6

BANDS = ["blue", "red", "nir"]
SCALES = {"blue": (0.02, 0.01), "red": (0.04, 0.02), "nir": (0.35, 0.15)}
WEIGHTS = np.round(np.cos(np.outer(np.arange(1, 7), np.arange(1, 6))), 6)
_SCALED = ", ".join(f"COALESCE((AVG(CASE WHEN fmask & 30 = 0 THEN {b} END) - {m}) / {s}, 0) AS {b}" for b, (m, s) in SCALES.items())
_MEDIANS = ", ".join(f"COALESCE(MEDIAN(NULLIF({b}, 0)) OVER (PARTITION BY tile_id, y, x, YEAR(month)), 0) AS m_{b}" for b in BANDS)
_SCORE = lambda c: " + ".join(f"{f} * ({float(WEIGHTS[i, c])!r})" for i, f in enumerate([*BANDS, *[f"m_{b}" for b in BANDS]]))


@query("class_map_job", f"""
    WITH m AS (SELECT tile_id, y, x, DATE_TRUNC('month', obs_date) AS month, {_SCALED} FROM $px_series GROUP BY 1, 2, 3, 4),
         f AS (SELECT *, {_MEDIANS} FROM m),
         s AS (SELECT tile_id, y, x, month, [{', '.join(_SCORE(c) for c in range(5))}] AS scores FROM f)
    SELECT tile_id, y, x, {day('month', 'month')}, CAST(LIST_POSITION(scores, LIST_MAX(scores)) - 1 AS INT) AS class FROM s""")
def class_map_job(t):
    """Months, annual medians, a fixed linear model, the best of five classes."""
    maps = class_maps.class_map(t.px_series, ["tile_id", "y", "x"], BANDS, SCALES, lambda m, w: m @ w, WEIGHTS)
    return maps.drop("error")


@query("ingest_patches", f"""
    WITH p AS (SELECT CONCAT('G', l.l_orderkey) AS granule_id, CAST(FLOOR(l_partkey / 2304) AS INT) AS tile_id, CAST(FLOOR((l_partkey % 2304) / 48) AS INT) AS y,
                      CAST(l_partkey % 48 AS INT) AS x, CAST(l_shipdate AS DATE) AS obs_date, l_tax * 10000 * 0.0001 AS red, (l_quantity * 250 - 500) * 0.0001 AS nir,
                      CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 8 WHEN 3 THEN 32 ELSE 64 END AS fmask
               FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o_custkey % 5 <> 0),
         c AS (SELECT granule_id, tile_id, y, x, obs_date, fmask, CASE WHEN fmask & 30 = 0 AND red BETWEEN 0 AND 1 THEN red END AS red,
                      CASE WHEN fmask & 30 = 0 AND nir BETWEEN 0 AND 1 THEN nir END AS nir FROM p),
         v AS (SELECT * FROM (SELECT *, AVG(CAST(red IS NOT NULL AS INT)) OVER (PARTITION BY tile_id, obs_date, granule_id) AS share FROM c) WHERE share >= 0.1),
         d AS (SELECT *, MIN(granule_id) OVER (PARTITION BY tile_id, obs_date) AS first FROM v)
    SELECT granule_id, tile_id, {day('obs_date', 'obs_date')}, y, x, {r6('red', 'red')}, {r6('nir', 'nir')}, fmask,
           CAST(FLOOR(y / 16) AS INT) AS patch_row, CAST(FLOOR(x / 16) AS INT) AS patch_col
    FROM d WHERE granule_id = first""")
def ingest_patches(t):
    links = t.granule_links.withColumn("links", F.split(F.trim("link_text"), " +"))
    part = F.col("l_partkey")
    pixels = t.lineitem.select(
        F.concat(F.lit("G"), F.col("l_orderkey").cast("string")).alias("granule_id"), F.floor(part / 2304).cast("int").alias("tile_id"),
        F.floor(part % 2304 / 48).cast("int").alias("y"), (part % 48).cast("int").alias("x"), F.col("l_shipdate").cast("date").alias("obs_date"),
        (F.col("l_tax") * 10000).alias("red"), (F.col("l_quantity") * 250 - 500).alias("nir"),
        F.when(F.col("l_linenumber") == 1, 2).when(F.col("l_linenumber") == 2, 8).when(F.col("l_linenumber") == 3, 32).otherwise(64).alias("fmask"))
    return ingest.ingest_patches(links, pixels, ["red", "nir"], 16)
