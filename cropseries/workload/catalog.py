"""Catalog, granule, source and sink operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, timegrid
from ..operators.quality import dedupe_dates
from ..session import scratch_path
from ..sources import catalog, granules, library, rasters
from .registry import day, hash_rank, query, r6


@query("patch_catalog", r"""
    SELECT file_name, split_part(file_name, '_', 1) AS tile_id, regexp_extract(file_name, 'patch_(.*)\.nc$', 1) AS patch_id
    FROM (SELECT DISTINCT file_name FROM $scene_files)""")
def patch_catalog(t):
    return catalog.patch_catalog(t.scene_files.distinct())


@query("tile_patch_combos", r"""
    WITH f AS (SELECT DISTINCT split_part(file_name, '_', 1) AS tile_id, regexp_extract(file_name, 'patch_(.*)\.nc$', 1) AS patch_id
               FROM $scene_files)
    SELECT tile_id, patch_id FROM (SELECT DISTINCT tile_id FROM f) CROSS JOIN (SELECT DISTINCT patch_id FROM f)
    WHERE EXISTS (SELECT 1 FROM $scene_files s WHERE s.file_name LIKE concat(tile_id, '\_%patch\_', patch_id, '.nc') ESCAPE '\')""")
def tile_patch_combos(t):
    return catalog.tile_patch_combos(catalog.patch_catalog(t.scene_files))


@query("distinct_ids", "SELECT DISTINCT split_part(file_name, '_', 1) AS tile_id FROM $scene_files")
def distinct_ids(t):
    return catalog.distinct_ids(catalog.patch_catalog(t.scene_files), "tile_id")


@query("pending_tiles", """
    SELECT DISTINCT CONCAT('t', l_suppkey) AS tile_id FROM lineitem
    WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def pending_tiles(t):
    tile = lambda c: F.concat(F.lit("t"), F.col(c).cast("string")).alias("tile_id")
    return catalog.pending_tiles(t.lineitem.select(tile("l_suppkey")).distinct(),
                                 t.supplier.filter("s_acctbal > 5000").select(tile("s_suppkey")))


def _search(limit):
    return f"""
    SELECT granule_id, product, {r6('min_lon', 'min_lon')}, {r6('min_lat', 'min_lat')} FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY begin_ts, granule_id) AS k FROM $granules
      WHERE min_lon <= -85.0 AND max_lon >= -89.0 AND min_lat <= 16.0 AND max_lat >= 13.5
        AND begin_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31') {limit}"""


_BOX = ((-89.0, 13.5, -85.0, 16.0), "1996-01-01 00:00:00", "2000-12-31 00:00:00")


@query("granule_search", _search(""))
def granule_search(t):
    return granules.granule_search(t.granules, *_BOX).select("granule_id", "product", "min_lon", "min_lat")


@query("granule_search_first", _search("WHERE k <= 2000"))
def granule_search_first(t):
    """The search with the caller's own limit per product."""
    return granules.granule_search(t.granules, *_BOX, max_results=2000).select("granule_id", "product", "min_lon", "min_lat")


@query("granule_metadata", f"""
    SELECT o_orderkey, metadata->>'$.umm.GranuleUR' AS granule_id,
           {day("CAST(metadata->>'$.umm.TemporalExtent.RangeDateTime.BeginningDateTime' AS TIMESTAMP)", 'begin_ts')},
           {r6("CAST(metadata->>'$.umm.AdditionalAttributes[1].Values[0]' AS DOUBLE)", 'cloud_cover')}
    FROM $granule_json""")
def granule_metadata(t):
    return granules.granule_metadata(t.granule_json).drop("metadata")


@query("cloud_filter", f"SELECT granule_id, {r6('cloud_cover', 'cloud_cover')} FROM $granules WHERE cloud_cover < 20")
def cloud_filter(t):
    return granules.cloud_filter(t.granules, 20).select("granule_id", "cloud_cover")


@query("granule_parse", f"SELECT granule_id, product, {day('begin_ts', 'obs_date')} FROM $granules")
def granule_parse(t):
    return granules.granule_parse(t.granules.select("granule_id"))


def _links(t):
    return granules.band_links(t.granule_links.withColumn("links", F.split(F.trim("link_text"), " +")))


@query("band_links", """
    SELECT granule_id, band, link FROM (
      SELECT granule_id, CASE sfx WHEN 'B02' THEN 'blue' WHEN 'B03' THEN 'green' WHEN 'B04' THEN 'red' WHEN 'Fmask' THEN 'fmask'
                                  WHEN 'B8A' THEN 'nir' WHEN 'B05' THEN 'nir' WHEN 'B11' THEN 'swir1' WHEN 'B06' THEN 'swir1' END AS band,
             link FROM (SELECT granule_id, link, split_part(link, '.', 2) AS sfx
                        FROM (SELECT granule_id, UNNEST(string_split(link_text, ' ')) AS link FROM $granule_links)))
    WHERE band IS NOT NULL AND link <> 'h/copy.B02.tif'""")
def band_links(t):
    return _links(t)


@query("complete_granules", """
    SELECT CONCAT('G', o_orderkey) AS granule_id FROM orders WHERE o_custkey % 5 <> 0""")
def complete_granules(t):
    return granules.complete_granules(_links(t))


@query("missing_bands", """
    SELECT CONCAT('G', o_orderkey) AS granule_id, 'nir' AS band FROM orders WHERE o_custkey % 5 = 0""")
def missing_bands(t):
    return granules.missing_bands(t.granule_links.select("granule_id").distinct(), _links(t))


_BBOX = """(SELECT MIN(min_lon) AS lon0, MIN(min_lat) AS lat0, MAX(max_lon) AS lon1, MAX(max_lat) AS lat1 FROM $granules)"""


def _grid(t):
    box = t.granules.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"),
                         F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))
    return catalog.tile_grid(t.spark, box, 0.25)


_GRID = f"""
    SELECT CAST(r * n_cols + c AS INT) AS cell_id, CAST(r AS INT) AS grid_row, CAST(c AS INT) AS grid_col,
           {r6('lon0 + c * 0.25', 'min_lon')}, {r6('lat0 + r * 0.25', 'min_lat')},
           {r6('lon0 + (c + 1) * 0.25', 'max_lon')}, {r6('lat0 + (r + 1) * 0.25', 'max_lat')}
    FROM (SELECT *, UNNEST(RANGE(0, n_cols)) AS c FROM (SELECT *, UNNEST(RANGE(0, n_rows)) AS r FROM
          (SELECT *, CAST(FLOOR((lon1 - lon0) / 0.25) AS BIGINT) AS n_cols, CAST(FLOOR((lat1 - lat0) / 0.25) AS BIGINT) AS n_rows
           FROM {_BBOX})))"""


@query("tile_grid", _GRID)
def tile_grid(t):
    return _grid(t)


@query("search_areas", f"""
    SELECT cell_id AS area_id, granule_id, product, {r6('g.min_lon', 'min_lon')}, {r6('g.min_lat', 'min_lat')} FROM $granules g JOIN (
        SELECT *, TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * (cell_id % 5 * 100) AS s, TIMESTAMP '1998-06-01' + INTERVAL 1 DAY * (cell_id % 7 * 50) AS e FROM ({_GRID})) a
    ON g.min_lon <= a.max_lon AND g.max_lon >= a.min_lon AND g.min_lat <= a.max_lat AND g.max_lat >= a.min_lat AND begin_ts BETWEEN s AND e""")
def search_areas(t):
    """All tiles of the grid, each with a period of its own, against all granules. Grid bounds to six decimals, as in the SQL."""
    bounds = {c: F.round(c, 6) for c in ("min_lon", "max_lon", "min_lat", "max_lat")}
    day = lambda first, n, k: F.expr(f"timestamp_ntz'{first}' + make_dt_interval(CAST(cell_id % {n} * {k} AS INT))")
    areas = _grid(t).withColumns({**bounds, "area_id": F.col("cell_id"), "start": day("1996-01-01", 5, 100), "end": day("1998-06-01", 7, 50)})
    return granules.search_areas(t.granules, areas, 0.5, 64).select("area_id", "granule_id", "product", "min_lon", "min_lat")


@query("tile_sample", f"SELECT * EXCLUDE k FROM (SELECT *, {hash_rank(42, 'cell_id')} AS k FROM ({_GRID})) WHERE k <= 50")
def tile_sample(t):
    return catalog.tile_sample(_grid(t), 50, seed=42)


def references(t):
    """Reference curves of all nations: 13 points, 1 to 4 stage days, a crop word for most."""
    curves = t.reference_points.groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("step", "vi"))).alias("_s"))
    n = F.col("ref_id")
    words = F.array(*[F.lit(w) for w in ("maize", "beans", "sorghum", "beans_double_season")])
    return curves.select(
        "ref_id", F.transform("_s", lambda s: s["vi"]).alias("vi"),
        F.transform(F.sequence(F.lit(0), n % 4), lambda i: (F.lit(20) + i * 42 + n % 10).cast("double")).alias("phen_days"),
        F.get(words, n % 5).alias("crop"))


@query("reference_curves", f"""
    SELECT ref_id, CAST(step AS INT) AS step, {r6('vi', 'vi')}, CAST(ref_id % 4 + 1 AS INT) AS n_stages,
           {r6('20 + (ref_id % 4) * 42 + ref_id % 10', 'last_day')},
           CASE ref_id % 5 WHEN 0 THEN 'maize' WHEN 1 THEN 'beans' WHEN 2 THEN 'sorghum' WHEN 3 THEN 'beans_double_season'
                           ELSE 'unknown' END AS crop
    FROM $reference_points""")
def reference_curves(t):
    path = scratch_path(t.spark, "reference-library")
    library.write_reference_library(references(t), path)
    stored = library.read_reference_library(t.spark, path)
    return stored.select("ref_id", F.posexplode("vi").alias("step", "vi"), F.size("phen_days").alias("n_stages"),
                         F.element_at("phen_days", -1).alias("last_day"), "crop")


@query("raster_roundtrip", f"SELECT tile_id, y, x, {day('obs_date', 'obs_date')}, {r6('green', 'green')}, {r6('red', 'red')}, {r6('nir', 'nir')} FROM $px_raster")
def raster_roundtrip(t):
    path = scratch_path(t.spark, "raster")
    rows = t.px_raster
    rasters.write_raster(rows, path, files_per_tile=8)
    return rasters.read_raster(t.spark, path, rows.schema)


@query("metrics_log", f"SELECT epoch, iter, name, {r6('value', 'value')} FROM $metrics_rows")
def metrics_log(t):
    path = scratch_path(t.spark, "metrics")
    rows = t.metrics_rows
    rasters.append_metrics(rows, path, ["epoch", "iter", "name", "value"])
    return rasters.load_metrics(t.spark, path, rows.schema)


@query("mosaic", f"SELECT tile_id, y, x, {r6('nir', 'nir')}, {r6('red', 'red')} FROM $px_image")
def mosaic(t):
    # two overlapping halves of every tile
    image = t.px_image
    left, right = image.filter("x < 30"), image.filter("x >= 18")
    return rasters.mosaic([left, right], ["tile_id", "y", "x"], ["nir", "red"])


@query("pair_targets", """
    SELECT DISTINCT file_name FROM $scene_files
    WHERE regexp_extract(file_name, 'patch_(.*)\\.nc$', 1) IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') FROM supplier WHERE s_acctbal > 0)""")
def pair_targets(t):
    inputs = catalog.patch_catalog(t.scene_files.distinct())
    targets = catalog.patch_catalog(t.patch_files.filter("s_acctbal > 0").select("file_name"))
    return raster.pair_targets(inputs, targets, ["patch_id"]).select("file_name")


@query("stack_dates", f"""
    SELECT l_suppkey, {day('l_shipdate', 'obs_date')}, {r6("CASE WHEN l_linestatus = 'O' THEN l_tax END", 'red')}, {r6('l_quantity / 100', 'nir')}
    FROM lineitem""")
def stack_dates(t):
    base = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("obs_date"), F.col("l_tax").alias("red"),
                             (F.col("l_quantity") / 100).alias("nir"), "l_linestatus")
    first = base.filter("l_linestatus = 'O'").drop("l_linestatus")
    second = base.filter("l_linestatus <> 'O'").drop("l_linestatus", "red")
    return timegrid.stack_dates(first, second)


@query("dedupe_dates", f"""
    SELECT {day('begin_ts', 'obs_date')}, MIN(granule_id) AS granule_id FROM $granules
    WHERE product = 'HLSL30' OR begin_ts NOT IN (SELECT begin_ts FROM $granules WHERE product = 'HLSL30') GROUP BY begin_ts""")
def dedupe_dates_query(t):
    scenes = t.granules.select(F.col("begin_ts").cast("date").alias("obs_date"), "product", "granule_id")
    return dedupe_dates(scenes, ["obs_date"], ["obs_date", "product", "granule_id"]).select("obs_date", "granule_id")
