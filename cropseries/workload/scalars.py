"""Row-level operators (scaling, masks, indices, encodings, dates, codes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, labels, spectral
from ..operators import bands, timegrid
from ..plans import chain
from .registry import day, drawn, query, r6

PX = "pixel_id, " + day("obs_date", "obs_date")


@query("scale_bands", f"""
    SELECT l_orderkey, l_linenumber, {r6('l_extendedprice * 0.0001', 'price')}, {r6('l_quantity * l_discount', 'quantity')},
           CAST(1.0 AS DOUBLE) AS factor FROM lineitem""")
def scale_bands(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
                           F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("factor"))
    return df.transform(bands.scale_bands, ["price"]).transform(bands.scale_bands, ["quantity"], factor="factor")


@query("repair_scale", f"""
    SELECT l_orderkey, l_linenumber,
           {r6('CASE WHEN l_extendedprice > 1 AND l_extendedprice < 100000 THEN l_extendedprice * 0.0001 ELSE l_extendedprice END', 'price')},
           {r6('CASE WHEN 5 - l_quantity < -10 THEN NULL WHEN 5 - l_quantity > 1 THEN (5 - l_quantity) * 0.0001 ELSE 5 - l_quantity END', 'quantity')},
           {r6('l_discount', 'discount')} FROM lineitem""")
def repair_scale(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
                           (5 - F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"))
    return bands.repair_scale(df, ["price", "quantity", "discount"])


@query("valid_range", f"""
    SELECT l_orderkey, l_linenumber, {r6('CASE WHEN l_quantity / 40 BETWEEN 0 AND 1 THEN l_quantity / 40 END', 'nir')},
           {r6('CASE WHEN l_tax - 0.02 BETWEEN 0 AND 1 THEN l_tax - 0.02 END', 'red')} FROM lineitem""")
def valid_range(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 40).alias("nir"),
                           (F.col("l_tax") - 0.02).alias("red"))
    return bands.valid_range(df, ["nir", "red"])


@query("fmask_mask", f"""
    SELECT {PX}, {r6('CASE WHEN fmask & 30 = 0 THEN red END', 'red')}, {r6('CASE WHEN fmask & 30 = 0 THEN nir END', 'nir')},
           {r6('CASE WHEN fmask & 62 = 0 THEN green END', 'green')}, fmask FROM $px_series""")
def fmask_mask(t):
    df = t.px_series.transform(bands.fmask_mask, ["red", "nir"]).transform(
        bands.fmask_mask, ["green"], bits=spectral.GENERIC_BITS)
    return df.select("pixel_id", "obs_date", "red", "nir", "green", "fmask")


_FORMULAS = {
    "grvi": ("green - red", "green + red"), "grvi_eq": ("green_eq - red_eq", "green_eq + red_eq"),
    "mgrvi": ("green * green - red * red", "green * green + red * red"),
    "rgbvi": ("green * green - blue * red", "green * green + blue * red"),
    "ndvi": ("nir - red", "nir + red"), "ndre": ("nir - edge", "nir + edge"), "gndvi": ("nir - green", "nir + green"),
    "regnvi": ("edge - green", "edge + green"), "reci": ("nir", "edge"),
    "evi": ("nir - red", "nir + 6 * red - 7.5 * blue + 1"),
    "negvi": ("nir * nir - edge * green", "nir * nir + edge * green"),
}


def _formula(name: str) -> str:
    top, bottom = _FORMULAS[name]
    ratio = f"({top}) / NULLIF({bottom}, 0)"
    return {"evi": f"2.5 * ({ratio})", "reci": f"{ratio} - 1"}.get(name, ratio)


@query("vegetation_indices", f"""
    SELECT {PX}, {', '.join(r6(_formula(n), n) for n in _FORMULAS)}
    FROM (SELECT *, swir1 AS edge, green * 2 AS green_eq, red * 3 AS red_eq FROM $px_series)""")
def vegetation_indices(t):
    df = t.px_series.withColumns({"edge": F.col("swir1"), "green_eq": F.col("green") * 2, "red_eq": F.col("red") * 3})
    return bands.vegetation_indices(df, list(_FORMULAS)).select("pixel_id", "obs_date", *_FORMULAS)


@query("custom_index", f"SELECT {PX}, {r6('(nir - swir1) / NULLIF(nir + 2 * swir1, 0) - red', 'moisture')} FROM $px_series")
def custom_index(t):
    return bands.custom_index(t.px_series, "(nir - swir1) / (nir + 2 * swir1) - red", "moisture") \
        .select("pixel_id", "obs_date", "moisture")


def _guarded(a: str, b: str) -> str:
    return f"GREATEST(LEAST(({a} - {b}) / ({a} + {b} + 1e-9), 1.0), -1.0)"


@query("ndvi_guarded", f"SELECT {PX}, {r6(_guarded('nir', 'red'), 'ndvi')}, {r6(_guarded('nir', 'green'), 'gndvi')} FROM $px_series")
def ndvi_guarded(t):
    return bands.ndvi_guarded(t.px_series).select("pixel_id", "obs_date", "ndvi", "gndvi")


@query("evi_values", f"""
    SELECT {PX}, {r6('NULLIF(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-9), 0)', 'evi')},
           {r6('NULLIF((nir - red) / (nir + red + 1e-9), 0)', 'ndvi')} FROM $px_series""")
def evi_values(t):
    return t.px_series.transform(bands.evi_values, "evi", out="evi").transform(bands.evi_values, "ndvi", out="ndvi") \
        .select("pixel_id", "obs_date", "evi", "ndvi")


@query("normalize_bands", "SELECT " + PX + ", " + ", ".join(
    r6(f"CASE WHEN {b} = 0 THEN 0 ELSE ({b} - {m}) / {s} END", b) for b, (m, s) in spectral.BAND_STATS[7].items()) + f"""
    FROM (SELECT *, {_guarded('nir', 'red')} AS ndvi, {_guarded('nir', 'green')} AS gndvi FROM $px_series)""")
def normalize_bands(t):
    return t.px_series.transform(bands.ndvi_guarded).transform(bands.normalize_bands, 7) \
        .select("pixel_id", "obs_date", *spectral.BAND_STATS[7])


@query("standard_scale", f"""
    SELECT {PX}, {r6('CASE WHEN green = 0 THEN 0 ELSE (green - m) / s END', 'green')}
    FROM $px_series, (SELECT AVG(l_discount) AS m, STDDEV_POP(l_discount) AS s FROM lineitem)""")
def standard_scale(t):
    return bands.standard_scale(t.px_series, "green").select("pixel_id", "obs_date", "green")


@query("minmax_scale", f"""
    SELECT {PX}, {r6('CASE WHEN nir = 0 THEN 0 ELSE (nir - lo) / (hi - lo) END', 'nir')}
    FROM $px_series, (SELECT MIN(0.1 + l_quantity / 100) AS lo, MAX(0.1 + l_quantity / 100) AS hi FROM lineitem)""")
def minmax_scale(t):
    return bands.minmax_scale(t.px_series, "nir").select("pixel_id", "obs_date", "nir")


@query("standard_scale_by_image", f"""
    SELECT {PX}, {r6('CASE WHEN green = 0 THEN 0 ELSE (green - m) / NULLIF(s, 0) END', 'green')}
    FROM $px_series JOIN (SELECT pixel_id, AVG(green) AS m, STDDEV_POP(green) AS s FROM $px_series GROUP BY 1) USING (pixel_id)""")
def standard_scale_by_image(t):
    return bands.standard_scale(t.px_series, "green", keys=["pixel_id"]).select("pixel_id", "obs_date", "green")


@query("minmax_scale_by_image", f"""
    SELECT {PX}, {r6('CASE WHEN nir = 0 THEN 0 ELSE (nir - lo) / NULLIF(hi - lo, 0) END', 'nir')}
    FROM $px_series JOIN (SELECT pixel_id, MIN(nir) AS lo, MAX(nir) AS hi FROM $px_series GROUP BY 1) USING (pixel_id)""")
def minmax_scale_by_image(t):
    return bands.minmax_scale(t.px_series, "nir", keys=["pixel_id"]).select("pixel_id", "obs_date", "nir")


@query("doy", f"SELECT {PX}, CAST(DAYOFYEAR(obs_date) AS INT) AS doy FROM $px_series")
def doy(t):
    return t.px_series.select("pixel_id", "obs_date", cal.doy("obs_date").alias("doy"))


@query("julian0", f"""
    SELECT {PX}, CAST(obs_date - MAKE_DATE(YEAR(obs_date), 1, 1) AS INT) AS julian0 FROM $px_series""")
def julian0(t):
    return t.px_series.select("pixel_id", "obs_date", cal.julian0("obs_date").alias("julian0"))


@query("day_offset", f"""
    SELECT {PX}, CAST(obs_date - first AS INT) AS day_offset
    FROM $px_series JOIN (SELECT CAST(l_suppkey AS INT) AS pixel_id, CAST(MIN(l_shipdate) AS DATE) AS first
                          FROM lineitem GROUP BY 1) USING (pixel_id)""")
def day_offset(t):
    return timegrid.day_offset(t.px_series, ["pixel_id"]).select("pixel_id", "obs_date", "day_offset")


@query("month_floor", f"SELECT {PX}, {day('DATE_TRUNC(' + chr(39) + 'month' + chr(39) + ', obs_date)', 'month_start')} FROM $px_series")
def month_floor(t):
    return t.px_series.select("pixel_id", "obs_date", cal.month_floor("obs_date").alias("month_start"))


@query("month_ends", """
    SELECT pixel_id, CAST(i AS INT) AS position,
           CAST(CASE WHEN MONTH(e) = 2 THEN MAKE_DATE(YEAR(e), 2, 28) ELSE e END AS VARCHAR) AS window_end
    FROM (SELECT pixel_id, i, LAST_DAY(CAST(DATE_TRUNC('month', last) - to_months(CAST(i AS INT)) AS DATE)) AS e
          FROM (SELECT pixel_id, MAX(obs_date) AS last FROM $px_series GROUP BY 1), (SELECT UNNEST(RANGE(0, 24)) AS i))""")
def month_ends(t):
    last = t.px_series.groupBy("pixel_id").agg(F.max("obs_date").alias("last"))
    return last.select("pixel_id", F.posexplode(cal.month_ends_back("last", 24)).alias("position", "window_end"))


@query("time_window", f"""
    SELECT {PX}, {r6('nir', 'nir')} FROM $px_series
    WHERE obs_date >= DATE '2000-12-31' - 1081 AND obs_date <= DATE '2000-12-31'""")
def time_window(t):
    return timegrid.time_window(t.px_series, end="2000-12-31", n_months=36).select("pixel_id", "obs_date", "nir")


@query("random_window", f"""
    WITH d AS (SELECT DISTINCT pixel_id, obs_date FROM $px_series), h AS (SELECT *, {drawn(42, 'pixel_id', 'obs_date')} AS h FROM d),
         l AS (SELECT pixel_id, MAX(obs_date) AS last FROM d GROUP BY 1),
         s AS (SELECT pixel_id, ARG_MIN(obs_date, (h, obs_date)) AS window_start FROM h JOIN l USING (pixel_id) WHERE obs_date <= last - 121 GROUP BY 1)
    SELECT {PX}, {day('window_start', 'window_start')}, {r6('nir', 'nir')} FROM $px_series JOIN s USING (pixel_id)
    WHERE obs_date BETWEEN window_start AND window_start + 181""")
def random_window(t):
    return timegrid.random_window(t.px_series, ["pixel_id"], 6, seed=42).select("pixel_id", "obs_date", "window_start", "nir")


@query("random_month_window", f"""
    WITH s AS (SELECT pixel_id, MIN(MONTH(obs_date)) AS lo, MAX(MONTH(obs_date)) - 5 AS hi FROM $px_series GROUP BY 1),
         w AS (SELECT pixel_id, CAST(lo + {drawn(42, 'pixel_id')} % (GREATEST(hi - lo, 0) + 1) AS INT) AS start_month FROM s)
    SELECT {PX}, start_month, {r6('nir', 'nir')} FROM $px_series JOIN w USING (pixel_id)
    WHERE MONTH(obs_date) >= start_month AND MONTH(obs_date) < start_month + 6""")
def random_month_window(t):
    return timegrid.random_month_window(t.px_series, ["pixel_id"], 6, seed=42).select("pixel_id", "obs_date", "start_month", "nir")


@query("lc_group", f"""
    SELECT {PX}, class,
           CASE WHEN class IN (11, 12, 13, 20) THEN 'crops' WHEN class IN (1, 2, 3, 4, 7, 8) THEN 'trees'
                WHEN class IN (17, 18) THEN 'water' WHEN class IN (15, 16) THEN 'soil' WHEN class = 14 THEN 'urban'
                WHEN class IN (5, 6, 21) THEN 'vegetation' WHEN class IN (9, 10, 19) THEN 'others' END AS lc_group,
           class IN (11, 12, 13, 20) AS is_crop
    FROM $class_map""")
def lc_group(t):
    return t.class_map.select("pixel_id", "obs_date", "class", labels.lc_group("class").alias("lc_group"),
                              labels.is_crop("class").alias("is_crop"))


_WORD = "CASE l_linenumber WHEN 1 THEN 'maize' WHEN 2 THEN 'beans' WHEN 3 THEN 'sorghum' WHEN 4 THEN 'beans_double_season' WHEN 5 THEN 'unknown' WHEN 6 THEN 'rice' END"


@query("crop_code", """
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber < 5 THEN l_linenumber ELSE 0 END AS INT) AS crop_code
    FROM lineitem""")
def crop_code(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", labels.crop_code(F.expr(_WORD)).alias("crop_code"))


@query("argmax_class", "SELECT vec_id, CAST(LIST_POSITION(embedding, LIST_MAX(embedding)) - 1 AS INT) AS class FROM embeddings")
def argmax_class(t):
    return t.embeddings.select("vec_id", labels.argmax_class("embedding").alias("class"))


@query("bands_long", f"""
    SELECT {PX}, l_linenumber, band, {r6('value', 'value')} FROM (
      SELECT *, UNNEST(['green', 'red', 'nir']) AS band, UNNEST([green, red, nir]) AS value FROM
      (SELECT CAST(l_suppkey AS INT) AS pixel_id, CAST(l_shipdate AS DATE) AS obs_date, l_linenumber,
              l_discount AS green, l_tax AS red, l_quantity / 100 AS nir FROM lineitem))""")
def bands_long(t):
    df = t.lineitem.select(F.col("l_suppkey").cast("int").alias("pixel_id"), F.col("l_shipdate").cast("date").alias("obs_date"),
                           "l_linenumber", F.col("l_discount").alias("green"), F.col("l_tax").alias("red"),
                           (F.col("l_quantity") / 100).alias("nir"))
    return bands.bands_long(df, ["pixel_id", "obs_date", "l_linenumber"], ["green", "red", "nir"])


EVENT_BANDS = ("click", "error", "purchase", "signup", "view")


@query("bands_wide", f"""
    SELECT {PX}, {', '.join(r6(f"MIN(value) FILTER (WHERE band = '{b}')", b) for b in EVENT_BANDS)}
    FROM $observations GROUP BY pixel_id, obs_date""")
def bands_wide(t):
    return bands.bands_wide(t.observations, ["pixel_id", "obs_date"], EVENT_BANDS)


@query("fill_zero", f"""
    SELECT {PX}, {r6('COALESCE(click, 0)', 'click')}, {r6('COALESCE(view, 0)', 'view')} FROM (
      SELECT pixel_id, obs_date, MIN(value) FILTER (WHERE band = 'click') AS click, MIN(value) FILTER (WHERE band = 'view') AS view
      FROM $observations GROUP BY 1, 2)""")
def fill_zero(t):
    return bands.fill_zero(bands.bands_wide(t.observations, ["pixel_id", "obs_date"], ["click", "view"]), ["click", "view"])


@query("zero_to_null", f"SELECT {PX}, {r6('NULLIF(red, 0)', 'red')}, {r6('NULLIF(green, 0)', 'green')} FROM $px_series")
def zero_to_null(t):
    return bands.zero_to_null(t.px_series, ["red", "green"]).select("pixel_id", "obs_date", "red", "green")


@query("pad_dates", f"""
    WITH d AS (SELECT pixel_id, obs_date, AVG(nir) AS nir, ROW_NUMBER() OVER (PARTITION BY pixel_id ORDER BY obs_date) - 1 AS step
               FROM $px_series GROUP BY 1, 2),
         g AS (SELECT pixel_id, UNNEST(RANGE(0, GREATEST(MAX(step) + 1, 1000))) AS step FROM d GROUP BY 1)
    SELECT pixel_id, CAST(step AS INT) AS step, {day('obs_date', 'obs_date')}, {r6('COALESCE(nir, 0)', 'nir')}
    FROM g LEFT JOIN d USING (pixel_id, step)""")
def pad_dates(t):
    return timegrid.pad_dates(timegrid.daily_mean(t.px_series, ["pixel_id"], ["nir"]), ["pixel_id"], ["nir"], 1000)


_EVENT_BANDS = ("click", "error", "purchase", "signup", "view")


@query("merge_bands", f"""
    SELECT {PX}, {', '.join(r6(f"MIN(CASE WHEN band = '{b}' THEN value END)", b) for b in _EVENT_BANDS)}
    FROM $observations GROUP BY pixel_id, obs_date""")
def merge_bands(t):
    single = {b: t.observations.filter(F.col("band") == b).withColumnRenamed("value", b).drop("band") for b in _EVENT_BANDS}
    return bands.merge_bands(single, ["pixel_id", "obs_date"])


@query("step_chain", f"""
    SELECT {PX}, {r6('CASE WHEN fmask & 30 = 0 THEN red END', 'red')},
           {r6('CASE WHEN fmask & 30 = 0 AND nir <= 0.4 THEN nir END', 'nir')},
           {r6('CASE WHEN fmask & 30 = 0 AND nir <= 0.4 THEN (nir - red) / NULLIF(nir + red, 0) END', 'ndvi')}
    FROM $px_series WHERE obs_date >= DATE '1995-01-01' AND obs_date <= DATE '2001-12-31'""")
def step_chain(t):
    return chain.run_steps(t.px_series, ["time_window", "fmask_mask", "valid_range", "vegetation_indices"], {
        "time_window": {"start": "1995-01-01", "end": "2001-12-31"}, "fmask_mask": {"bands": ["red", "nir"]},
        "valid_range": {"bands": ["nir"], "high": 0.4}, "vegetation_indices": {"names": ["ndvi"]},
    }).select("pixel_id", "obs_date", "red", "nir", "ndvi")
