"""Temporal composites, curves, matching and calendar-map operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from ..operators import matching, phenology, series, timegrid
from ..operators.bands import fmask_mask
from ..plans import calendar_maps
from ..session import written_table
from .catalog import references
from .registry import day, query, r6

KEYS = ["pixel_id"]
CLEAR = "(SELECT pixel_id, tile_id, obs_date, " + ", ".join(
    f"CASE WHEN fmask & 30 = 0 THEN {b} END AS {b}" for b in ("blue", "green", "red", "nir", "swir1")) + " FROM $px_series)"
EVI = "NULLIF(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-9), 0)"


def _last(t):
    return t.px_series.agg(F.max("obs_date").alias("d")).scalar()


# as many slots as reach from the last date of the table back to its first
SLOTTED = f"""
    span AS (SELECT MAX(obs_date) AS last, CAST(FLOOR((MAX(obs_date) - MIN(obs_date)) / 14) AS INT) + 1 AS steps FROM $px_series),
    slotted AS (SELECT c.*, steps - 1 - CAST(FLOOR((last - obs_date) / 14) AS INT) AS slot, last FROM {CLEAR} c, span),
    grid AS (SELECT pixel_id, last, steps, CAST(UNNEST(RANGE(0, steps)) AS INT) AS slot FROM (SELECT DISTINCT pixel_id FROM $px_series), span)"""

NANMEAN = f"""{SLOTTED},
    m AS (SELECT pixel_id, slot, AVG(obs_date - DATE '1970-01-01') AS mean_day, AVG(blue) AS blue, AVG(red) AS red, AVG(nir) AS nir
          FROM slotted GROUP BY 1, 2),
    composite AS (SELECT pixel_id, slot,
                         COALESCE(DATE '1970-01-01' + CAST(FLOOR(mean_day) AS INT), last - 14 * (steps - 1 - slot)) AS slot_date,
                         COALESCE(blue, 0) AS blue, COALESCE(red, 0) AS red, COALESCE(nir, 0) AS nir
                  FROM grid LEFT JOIN m USING (pixel_id, slot))"""


def _composite(t):
    clear = fmask_mask(t.px_series, ["blue", "red", "nir"])
    return timegrid.composite_nanmean(clear, KEYS, ["blue", "red", "nir"], _last(t), steps=timegrid.steps_between(t.px_series))


@query("composite_nanmean", f"""WITH {NANMEAN}
    SELECT pixel_id, slot, {day('slot_date', 'slot_date')}, {r6('blue', 'blue')}, {r6('red', 'red')}, {r6('nir', 'nir')} FROM composite""")
def composite_nanmean(t):
    return _composite(t)


@query("composite_recent", f"""
    WITH last AS (SELECT MAX(obs_date) AS last FROM $px_raster), grid AS (
        SELECT tile_id, y, x, last, CAST(UNNEST(RANGE(0, 13)) AS INT) AS slot FROM (SELECT DISTINCT tile_id, y, x FROM $px_raster), last),
    m AS (SELECT tile_id, y, x, 12 - CAST(FLOOR((last - obs_date) / 14) AS INT) AS slot, AVG(red) AS red, AVG(nir) AS nir
          FROM $px_raster, last WHERE last - obs_date < 182 GROUP BY 1, 2, 3, 4)
    SELECT tile_id, y, x, slot, {r6('COALESCE(red, 0)', 'red')}, {r6('COALESCE(nir, 0)', 'nir')} FROM grid LEFT JOIN m USING (tile_id, y, x, slot)""")
def composite_recent(t):
    """The last six months of the raster: most pixels have no date there and stay with empty slots."""
    last = t.px_raster.agg(F.max("obs_date").alias("d")).scalar()
    return timegrid.composite_nanmean(t.px_raster, ["tile_id", "y", "x"], ["red", "nir"], last, 6).drop("slot_date")


@query("evi_curves", f"""WITH {NANMEAN}
    SELECT pixel_id, slot, {day('slot_date', 'slot_date')}, {r6(EVI, 'vi')} FROM composite""")
def evi_curves(t):
    """Mask, composite, EVI: the 14-day cloud-free EVI curve of each pixel."""
    from ..operators.bands import evi_values
    return evi_values(_composite(t)).select("pixel_id", "slot", "slot_date", "vi")


@query("composite_grid", f"""WITH {SLOTTED},
    m AS (SELECT pixel_id, slot, AVG(COALESCE(red, 0)) AS red, AVG(COALESCE(nir, 0)) AS nir FROM slotted GROUP BY 1, 2)
    SELECT pixel_id, slot, {r6('COALESCE(red, 0)', 'red')}, {r6('COALESCE(nir, 0)', 'nir')},
           CAST(DAYOFYEAR(last - 14 * (steps - 1 - slot)) AS INT) AS doy, {r6(f'DAYOFYEAR(last - 14 * (steps - 1 - slot)) / 365.0', 'day')}
    FROM grid LEFT JOIN m USING (pixel_id, slot)""")
def composite_grid(t):
    clear = fmask_mask(t.px_series, ["red", "nir"])
    return timegrid.composite_grid(clear, KEYS, ["red", "nir"], _last(t), timegrid.steps_between(t.px_series))


@query("daily_mean", f"""
    SELECT pixel_id, {day('obs_date', 'obs_date')}, {r6('AVG(red)', 'red')}, {r6('AVG(nir)', 'nir')} FROM $px_series GROUP BY pixel_id, obs_date""")
def daily_mean(t):
    return timegrid.daily_mean(t.px_series, KEYS, ["red", "nir"])


@query("annual_median", f"""
    SELECT tile_id, y, x, {r6('COALESCE(MEDIAN(NULLIF(red, 0)), 0)', 'red')}, {r6('COALESCE(MEDIAN(NULLIF(nir, 0)), 0)', 'nir')}
    FROM $px_raster GROUP BY tile_id, y, x""")
def annual_median(t):
    return timegrid.annual_median(t.px_raster, ["tile_id", "y", "x"], ["red", "nir"])


@query("modal_class", """
    WITH c AS (SELECT pixel_id, class, COUNT(*) AS n FROM $class_map GROUP BY 1, 2),
         k AS (SELECT pixel_id, CASE WHEN class IN (11, 12, 13, 20) THEN 1 ELSE 0 END AS flag, SUM(n) AS n FROM c GROUP BY 1, 2)
    SELECT pixel_id, class, CAST(flag AS INT) AS crop_mask
    FROM (SELECT pixel_id, class FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pixel_id ORDER BY n DESC, class) AS r FROM c) WHERE r = 1)
    JOIN (SELECT pixel_id, flag FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pixel_id ORDER BY n DESC, flag) AS r FROM k) WHERE r = 1)
    USING (pixel_id)""")
def modal_class(t):
    return phenology.modal_class(t.class_map, KEYS)


@query("latest_windows", f"""
    SELECT pixel_id, {day('LAST_DAY(obs_date)', 'window_end')}, COUNT(*) AS n FROM $px_series
    WHERE LAST_DAY(obs_date) IN (SELECT DISTINCT LAST_DAY(obs_date) AS e FROM $px_series ORDER BY e DESC LIMIT 8)
    GROUP BY pixel_id, LAST_DAY(obs_date)""")
def latest_windows(t):
    monthly = t.px_series.withColumn("window_end", F.last_day("obs_date"))
    return timegrid.latest_windows(monthly, 8).groupBy("pixel_id", "window_end").agg(F.count("*").alias("n"))


# --- curves of every pixel and month window -------------------------------------------------

WINDOWS = f"""
    ends AS (SELECT DISTINCT CASE WHEN MONTH(e) = 2 THEN MAKE_DATE(YEAR(e), 2, 28) ELSE e END AS window_end
             FROM (SELECT LAST_DAY(obs_date) AS e FROM $px_series)),
    placed AS (SELECT c.*, window_end, 12 - CAST(FLOOR((window_end - obs_date) / 14) AS INT) AS slot
               FROM {CLEAR} c JOIN ends ON obs_date <= window_end AND window_end - obs_date < 182),
    slot_means AS (SELECT pixel_id, window_end, slot, AVG(obs_date - DATE '1970-01-01') AS mean_day,
                          AVG(blue) AS blue, AVG(red) AS red, AVG(nir) AS nir FROM placed GROUP BY 1, 2, 3),
    full_grid AS (SELECT pixel_id, window_end, CAST(UNNEST(RANGE(0, 13)) AS INT) AS slot
                  FROM (SELECT DISTINCT pixel_id, window_end FROM placed)),
    filled AS (SELECT pixel_id, window_end, slot,
                      COALESCE(DATE '1970-01-01' + CAST(FLOOR(mean_day) AS INT), window_end - 14 * (12 - slot)) AS slot_date,
                      COALESCE(blue, 0) AS blue, COALESCE(red, 0) AS red, COALESCE(nir, 0) AS nir
               FROM full_grid LEFT JOIN slot_means USING (pixel_id, window_end, slot)),
    curve AS (SELECT pixel_id, window_end, slot,
                     CAST(slot_date - FIRST_VALUE(slot_date) OVER (PARTITION BY pixel_id, window_end ORDER BY slot) AS DOUBLE) AS d,
                     {EVI} AS vi FROM filled)"""

KERNEL = f"""{WINDOWS},
    span AS (SELECT pixel_id, window_end, COUNT(vi) AS n, MIN(CASE WHEN vi IS NOT NULL THEN d END) AS lo,
                    GREATEST(MAX(CASE WHEN vi IS NOT NULL THEN d END) - MIN(CASE WHEN vi IS NOT NULL THEN d END), 1e-6) AS width
             FROM curve GROUP BY 1, 2),
    weights AS (SELECT a.pixel_id, a.window_end, a.slot, EXP(-0.5 * POWER((a.d - b.d) / s.width / 0.03, 2)) AS w, b.vi
                FROM curve a JOIN curve b ON a.pixel_id = b.pixel_id AND a.window_end = b.window_end AND b.vi IS NOT NULL
                JOIN span s ON s.pixel_id = a.pixel_id AND s.window_end = a.window_end),
    fits AS (SELECT pixel_id, window_end, slot, SUM(w * vi) / NULLIF(SUM(w), 0) AS fit FROM weights GROUP BY 1, 2, 3),
    kernel AS (SELECT pixel_id, window_end, slot, CASE WHEN s.n < 3 THEN c.vi ELSE f.fit END AS vi
               FROM curve c JOIN span s USING (pixel_id, window_end) LEFT JOIN fits f USING (pixel_id, window_end, slot))"""

# Savitzky-Golay weights (11, 7); the second pass (3, 2) is the identity, so the result is the upper envelope.
_SG = {0: 0.47593582887700536, 1: 0.32250102838338131, 2: 0.011517893870834, 3: -0.12669683257918549,
       4: 0.066227889757301525, 5: -0.011517893870834}


def envelope(source: str, name: str) -> str:
    taps = " + ".join(f"{_SG[abs(k)]!r} * v[((i + {k} + 13) % 13) + 1]" for k in range(-5, 6))
    return f"""
    {name}_lists AS (SELECT pixel_id, window_end, LIST(vi ORDER BY slot) AS v, COUNT(vi) AS n FROM {source} GROUP BY 1, 2),
    {name} AS (SELECT pixel_id, window_end, CAST(i AS INT) AS slot, CASE WHEN n = 13 THEN GREATEST({taps}, v[i + 1]) END AS vi
               FROM (SELECT *, UNNEST(RANGE(0, 13)) AS i FROM {name}_lists))"""


SMOOTH = f"{KERNEL}, {envelope('kernel', 'envelope')}, smooth AS (SELECT pixel_id, window_end, slot, COALESCE(vi, 0) AS vi FROM envelope)"


def month_curves(t):
    """Raw EVI curves of every pixel and month window."""
    clear = fmask_mask(t.px_series, ["blue", "red", "nir"])
    return calendar_maps.vi_array(timegrid.month_window_series(clear, KEYS, ["blue", "red", "nir"], _last(t), 1200))


def _long(df):
    return df.select("pixel_id", "window_end", F.posexplode("vi").alias("slot", "vi"))


CURVE_OUT = f"pixel_id, {day('window_end', 'window_end')}, slot"


@query("month_window_series", f"WITH {WINDOWS} SELECT {CURVE_OUT}, {r6('d', 'd')}, {r6('vi', 'vi')} FROM curve")
def month_window_series(t):
    both = month_curves(t).select("pixel_id", "window_end", F.posexplode(F.arrays_zip("days", "vi")).alias("slot", "p"))
    return both.select("pixel_id", "window_end", "slot", F.col("p.days").alias("d"), F.col("p.vi").alias("vi"))


@query("kernel_regression", f"WITH {KERNEL} SELECT {CURVE_OUT}, {r6('vi', 'vi')} FROM kernel")
def kernel_regression(t):
    return _long(series.kernel_smooth(month_curves(t)))


@query("chen_sg", f"WITH {WINDOWS}, {envelope('curve', 'env')} SELECT {CURVE_OUT}, {r6('vi', 'vi')} FROM env WHERE vi IS NOT NULL")
def chen_sg(t):
    return _long(series.chen_sg(month_curves(t))).filter("vi IS NOT NULL")


@query("smooth_series", f"""WITH {SMOOTH}
    SELECT {CURVE_OUT}, {r6('CASE WHEN pixel_id % 4 <> 3 THEN vi ELSE 0 END', 'vi')} FROM smooth""")
def smooth_series(t):
    # crop flag of the class map's main classes 11, 12, 13
    return _long(series.smooth_series(month_curves(t).withColumn("is_crop", F.col("pixel_id") % 4 != 3)))


def smooth_curves(t):
    return series.smooth_series(month_curves(t), crop=None)


MATCHED = f"""{SMOOTH},
    probe AS (SELECT pixel_id, window_end, slot, vi FROM smooth
              WHERE (pixel_id, window_end) IN (SELECT (pixel_id, window_end) FROM smooth GROUP BY pixel_id, window_end HAVING MAX(ABS(vi)) > 0)),
    dist AS (SELECT p.pixel_id, p.window_end, r.ref_id, SQRT(SUM(POWER(p.vi - r.vi, 2))) AS distance
             FROM probe p JOIN $reference_points r ON r.step = p.slot GROUP BY 1, 2, 3),
    best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pixel_id, window_end ORDER BY distance, ref_id) AS k FROM dist) WHERE k = 1)"""


@query("nearest_reference", f"""WITH {MATCHED}
    SELECT pixel_id, {day('window_end', 'window_end')}, ref_id, {r6('distance', 'distance')} FROM best WHERE distance <= 0.9""")
def nearest_reference(t):
    matched = matching.nearest_reference(smooth_curves(t), ["pixel_id", "window_end"], references(t), 0.9)
    return matched.select("pixel_id", "window_end", "ref_id", "distance")


@query("nearest_reference_dtw")
def nearest_reference_dtw(t):
    matched = matching.nearest_reference_dtw(smooth_curves(t), ["pixel_id", "window_end"], references(t), 2.0)
    return matched.select("pixel_id", "window_end", "ref_id", "distance")


CLUSTERED = f"""{SMOOTH},
    member AS (SELECT *, pixel_id % 7 AS cluster_id, CAST(FLOOR(pixel_id / 2304) AS INT) AS tile_id FROM smooth
               WHERE (pixel_id, window_end) IN (SELECT (pixel_id, window_end) FROM smooth GROUP BY pixel_id, window_end HAVING MAX(ABS(vi)) > 0)),
    cluster_curve AS (SELECT tile_id, window_end, cluster_id, slot AS step, MEDIAN(vi) AS vi FROM member GROUP BY 1, 2, 3, 4)"""


def _labelled(t):
    return written_table(smooth_curves(t), "curves").withColumns({"cluster_id": F.col("pixel_id") % 7,
                                         "tile_id": F.floor(F.col("pixel_id") / 2304).cast("int")})


GROUP = ["tile_id", "window_end", "cluster_id"]


@query("cluster_curve", f"""WITH {CLUSTERED}
    SELECT tile_id, {day('window_end', 'window_end')}, cluster_id, step, {r6('vi', 'vi')} FROM cluster_curve""")
def cluster_curve(t):
    return phenology.cluster_curve(_labelled(t), GROUP)


@query("cluster_curve_mean", f"""WITH {SMOOTH}
    SELECT CAST(FLOOR(pixel_id / 2304) AS INT) AS tile_id, {day('window_end', 'window_end')}, pixel_id % 7 AS cluster_id, slot AS step, {r6('AVG(vi)', 'vi')}
    FROM smooth GROUP BY 1, 2, 3, 4""")
def cluster_curve_mean(t):
    return phenology.cluster_curve(_labelled(t), GROUP, "mean", drop_zero_rows=False)


@query("pixel_cluster_match", f"""WITH {CLUSTERED},
    pair AS (SELECT m.pixel_id, m.window_end, c.cluster_id, SQRT(SUM(POWER(m.vi - c.vi, 2))) AS distance
             FROM member m JOIN cluster_curve c ON c.tile_id = m.tile_id AND c.window_end = m.window_end AND c.step = m.slot
             GROUP BY 1, 2, 3)
    SELECT pixel_id, {day('window_end', 'window_end')}, cluster_id, {r6('distance', 'distance')}
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pixel_id, window_end ORDER BY distance, cluster_id) AS k FROM pair)
    WHERE k = 1 AND distance < 0.8""")
def pixel_cluster_match(t):
    members = _labelled(t)
    arrays = phenology.curve_arrays(phenology.cluster_curve(members, GROUP), GROUP).withColumnRenamed("vi", "cluster_vi")
    return matching.pixel_cluster_match(members.drop("cluster_id"), arrays, ["tile_id", "window_end"], 0.8) \
        .select("pixel_id", "window_end", "cluster_id", "distance")


# stage days on a calendar: one 0-based day per pixel, month and stage
DOYS = """(SELECT pixel_id, stage, CAST(obs_date - MAKE_DATE(YEAR(obs_date), 1, 1) AS INT) AS doy
           FROM (SELECT pixel_id, obs_date, CASE fmask WHEN 2 THEN 'Greenup' WHEN 8 THEN 'Maturity' WHEN 32 THEN 'Senescence' ELSE 'Dormancy' END AS stage
                 FROM $px_series))"""


def _doys(t):
    from ..functions.calendar import julian0
    stage = F.when(F.col("fmask") == 2, "Greenup").when(F.col("fmask") == 8, "Maturity") \
        .when(F.col("fmask") == 32, "Senescence").otherwise("Dormancy")
    return t.px_series.select("pixel_id", stage.alias("stage"), julian0("obs_date").alias("doy"))


@query("stage_median", f"SELECT pixel_id, stage, {r6('MEDIAN(NULLIF(doy, 0))', 'doy')} FROM {DOYS} GROUP BY pixel_id, stage")
def stage_median(t):
    return phenology.stage_median(_doys(t), ["pixel_id", "stage"])


@query("biweekly_snap", f"SELECT pixel_id, stage, {r6('CASE WHEN doy < 364 THEN FLOOR(doy / 14) * 14 + 7 ELSE doy END', 'doy')} FROM {DOYS}")
def biweekly_snap(t):
    return phenology.biweekly_snap(_doys(t))


@query("suppress_rare", f"""
    WITH d AS (SELECT pixel_id, stage, CASE WHEN doy < 364 THEN FLOOR(doy / 14) * 14 + 7 ELSE doy END AS doy FROM {DOYS}),
         n AS (SELECT *, COUNT(*) OVER (PARTITION BY stage, doy) * 100.0 / COUNT(*) OVER (PARTITION BY stage) AS share FROM d)
    SELECT pixel_id, stage, {r6('CASE WHEN share >= 1 THEN doy END', 'doy')} FROM n""")
def suppress_rare(t):
    return phenology.suppress_rare(phenology.biweekly_snap(_doys(t)), ["stage"])


# 8e-1 is a DOUBLE literal, 0.8 would be a DECIMAL
_SCALE, _P0, _MOVE = "(8e-1 + s_suppkey % 5 * 1e-1)", "(20 + s_suppkey % 60)", "(s_suppkey % 13 - 6)"


@query("curve_shift", f"""
    WITH r AS (SELECT ref_id, LIST(vi ORDER BY step) AS v FROM $reference_points GROUP BY 1),
         p AS (SELECT s_suppkey, v, CAST(i AS INT) AS step, LEAST(GREATEST((FLOOR(LEAST(GREATEST(
                   (i * 14 + 1) * {_SCALE} + (1 - {_SCALE}) * {_P0} + {_MOVE} * {_SCALE}, 0), 179) * 100) / 100 - 1) / 14, 0), 12) AS pos
               FROM (SELECT s_suppkey, v, UNNEST(RANGE(0, 13)) AS i FROM r JOIN supplier ON s_nationkey = ref_id))
    SELECT s_suppkey, step,
           {r6('v[CAST(FLOOR(pos) AS INT) + 1] + (v[LEAST(CAST(FLOOR(pos) AS INT) + 2, 13)] - v[CAST(FLOOR(pos) AS INT) + 1]) * (pos - FLOOR(pos))', 'vi')}
    FROM p""")
def curve_shift(t):
    """Each supplier's curve is its nation's, moved and stretched by its own parameters."""
    n = F.col("s_suppkey")
    curve = t.supplier.join(references(t), F.col("s_nationkey") == F.col("ref_id"))
    shifted = curves.curve_shift("vi", (F.lit(20) + n % 60).cast("double"), (n % 13 - 6).cast("double"), F.lit(0.8) + n % 5 * 0.1)
    return curve.select("s_suppkey", F.posexplode(shifted).alias("step", "vi"))


def _rules(zero_is_missing: bool) -> str:
    cols = ("greenup", "maturity", "senescence", "dormancy")
    start = ", ".join(f"NULLIF({c}, 0) AS {c}" if zero_is_missing else c for c in cols)
    orphan = "greenup IS NULL" if zero_is_missing else "greenup IS NULL AND (maturity IS NULL OR senescence IS NULL)"
    return f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, pixel_id, first_date, {start} FROM $stage_days),
         b AS (SELECT * REPLACE (CASE WHEN {orphan} THEN NULL ELSE maturity END AS maturity,
                                 CASE WHEN {orphan} THEN NULL ELSE senescence END AS senescence) FROM a),
         c AS (SELECT *, COALESCE(maturity - greenup > 105 OR greenup >= maturity, FALSE) AS bad FROM b),
         d AS (SELECT * REPLACE (CASE WHEN bad THEN NULL ELSE greenup END AS greenup, CASE WHEN bad THEN NULL ELSE maturity END AS maturity) FROM c),
         e AS (SELECT * REPLACE (CASE WHEN greenup IS NULL AND maturity IS NULL AND dormancy IS NULL THEN NULL ELSE senescence END AS senescence) FROM d),
         f AS (SELECT *, COALESCE(dormancy - senescence > 105, FALSE) AS late FROM e),
         rules AS (SELECT l_orderkey, l_linenumber, pixel_id, first_date, greenup, maturity, CASE WHEN late THEN NULL ELSE senescence END AS senescence,
                          CASE WHEN late THEN NULL ELSE dormancy END AS dormancy FROM f)"""


_STAGE_OUT = "l_orderkey, l_linenumber, " + ", ".join(r6(c, c) for c in ("greenup", "maturity", "senescence", "dormancy"))


def _stages(t):
    return t.stage_days.withColumns({c: F.col(c).cast("double") for c in phenology.STAGE_COLUMNS})


@query("validate_phenology", f"{_rules(True)} SELECT {_STAGE_OUT} FROM rules")
def validate_phenology(t):
    return phenology.validate_phenology(_stages(t)).select("l_orderkey", "l_linenumber", *phenology.STAGE_COLUMNS)


@query("check_phenology", f"{_rules(False)} SELECT {_STAGE_OUT} FROM rules")
def check_phenology(t):
    return phenology.check_phenology(_stages(t)).select("l_orderkey", "l_linenumber", *phenology.STAGE_COLUMNS)


@query("phenology_dates", f"""{_rules(True)},
    long AS (SELECT l_orderkey, l_linenumber, first_date, UNNEST(['Greenup', 'Maturity', 'Senescence', 'Dormancy']) AS stage,
                    UNNEST([greenup, maturity, senescence, dormancy]) AS day FROM rules),
    dated AS (SELECT *, first_date + CAST(TRUNC(NULLIF(day, 0)) AS INT) AS event_date FROM long)
    SELECT l_orderkey, l_linenumber, stage, {day('event_date', 'event_date')},
           CAST(event_date - MAKE_DATE(YEAR(event_date), 1, 1) AS INT) AS doy FROM dated""")
def phenology_dates(t):
    long = phenology.stages_long(phenology.validate_phenology(_stages(t)), ["l_orderkey", "l_linenumber", "first_date"])
    return phenology.phenology_dates(long).select("l_orderkey", "l_linenumber", "stage", "event_date", "doy")
