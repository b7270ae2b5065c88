"""Metrics, losses and scene-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, quality
from .registry import day, query, r6

CELLS = """cells AS (SELECT CAST(l AS INT) AS label, CAST(p AS INT) AS predicted FROM (SELECT UNNEST(RANGE(0, 7)) AS l), (SELECT UNNEST(RANGE(0, 7)) AS p)),
    matrix AS (SELECT label, predicted, COUNT(q.l_orderkey) AS n FROM cells LEFT JOIN $predictions q USING (label, predicted) GROUP BY 1, 2)"""
COUNTS = f"""{CELLS},
    totals AS (SELECT c.class, SUM(CASE WHEN label = c.class AND predicted = c.class THEN n ELSE 0 END) AS tp,
                      SUM(CASE WHEN label <> c.class AND predicted = c.class THEN n ELSE 0 END) AS fp,
                      SUM(CASE WHEN label = c.class AND predicted <> c.class THEN n ELSE 0 END) AS fn
               FROM (SELECT DISTINCT label AS class FROM cells) c, matrix WHERE label = c.class OR predicted = c.class GROUP BY 1)"""


@query("confusion_matrix", f"WITH {CELLS} SELECT label, predicted, CAST(n AS BIGINT) AS n FROM matrix")
def confusion_matrix(t):
    return metrics.confusion_matrix(t.predictions, 7)


_NAMES = ("accuracy", "precision", "recall", "f1", "iou")


@query("class_metrics", f"""WITH {COUNTS},
    rate AS (SELECT class, tp / NULLIF(tp + fn, 0) AS accuracy, tp / NULLIF(tp + fp, 0) AS precision, tp / NULLIF(tp + fn, 0) AS recall,
                    tp / NULLIF(tp + fp + fn, 0) AS iou FROM totals),
    rated AS (SELECT *, 2 * precision * recall / NULLIF(precision + recall, 0) AS f1 FROM rate),
    s AS (SELECT SUM(tp) AS tp, SUM(fp) AS fp, SUM(fn) AS fn FROM totals),
    joined AS (SELECT 'class' AS scope, class, {', '.join(f'COALESCE({n}, 0) AS {n}' for n in _NAMES)} FROM rated
             UNION ALL SELECT 'macro', NULL, {', '.join(f'AVG({n})' for n in _NAMES)} FROM rated
             UNION ALL SELECT 'micro', NULL, tp / (tp + fn), tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp / (tp + fp + fn) FROM s)
    SELECT scope, class, {', '.join(r6(n, n) for n in _NAMES)} FROM joined""")
def class_metrics(t):
    return metrics.class_metrics(t.predictions, 7)


@query("iou_report", f"""WITH {COUNTS}, i AS (SELECT class, tp / GREATEST(tp + fp + fn, 1) AS iou FROM totals)
    SELECT class, {r6('iou', 'iou')} FROM i UNION ALL SELECT NULL, {r6('AVG(iou)', 'iou')} FROM i""")
def iou_report(t):
    return metrics.iou_report(t.predictions, 7)


@query("accuracy", f"""
    SELECT CAST(SUM(CASE WHEN label = predicted THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, COUNT(*) AS n_total,
           {r6('AVG(CASE WHEN label = predicted THEN 1.0 ELSE 0 END)', 'accuracy')} FROM $predictions""")
def accuracy(t):
    return metrics.accuracy(t.predictions)


@query("per_class_loss", f"SELECT label, {r6('AVG(loss)', 'mean_loss')} FROM $predictions GROUP BY label")
def per_class_loss(t):
    return metrics.per_class_loss(t.predictions)


_LOGP = """(SELECT label, CAST(embedding[label + 1] AS DOUBLE) - top - LN(LIST_SUM(LIST_TRANSFORM(embedding, lambda s: EXP(CAST(s AS DOUBLE) - top)))) AS log_p
            FROM (SELECT label, embedding, CAST(LIST_MAX(embedding) AS DOUBLE) AS top FROM embeddings))"""


def _scores(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").alias("scores"))


@query("masked_cross_entropy", f"SELECT {r6('COALESCE(AVG(-log_p), 0)', 'loss')} FROM {_LOGP} WHERE label <> 0")
def masked_cross_entropy(t):
    return metrics.masked_cross_entropy(_scores(t))


_ALPHA = [0.1 * (i + 1) for i in range(10)]


@query("masked_focal", f"""
    SELECT {r6('SUM(-POWER(1 - EXP(log_p), 2) * log_p * (label + 1) * 0.1)', 'loss')} FROM {_LOGP} WHERE label <> 0""")
def masked_focal(t):
    return metrics.masked_focal(_scores(t), gamma=2.0, alpha=_ALPHA, ignore_class=0, reduction="sum")


@query("metrics_summary", f"""
    SELECT CONCAT_WS('-', CAST(epoch AS VARCHAR), name) AS group_key, {r6('AVG(value)', 'value')}, {r6('AVG(iter)', 'iter')}
    FROM $metrics_rows GROUP BY 1""")
def metrics_summary(t):
    return metrics.metrics_summary(t.metrics_rows, ["epoch", "name"], ["value", "iter"])


@query("metrics_summary_custom", f"""
    SELECT name AS group_key, {r6('MAX(value) - MIN(value)', 'value')} FROM $metrics_rows GROUP BY 1""")
def metrics_summary_custom(t):
    return metrics.metrics_summary(t.metrics_rows, "name", ["value"], lambda c: F.max(c) - F.min(c))


CLEAR_RASTER = "(SELECT *, CASE WHEN nir < 0.4 THEN red END AS clear_red FROM $px_raster)"


def _clear_raster(t):
    return t.px_raster.withColumn("clear_red", F.when(F.col("nir") < 0.4, F.col("red")))


@query("coverage_filter", f"""
    SELECT tile_id, y, x, {day('obs_date', 'obs_date')}, {r6('nir', 'nir')} FROM {CLEAR_RASTER} r
    WHERE (tile_id, obs_date) IN (SELECT (tile_id, obs_date) FROM {CLEAR_RASTER} GROUP BY tile_id, obs_date HAVING COUNT(clear_red) * 100.0 / COUNT(*) > 75)""")
def coverage_filter(t):
    return quality.coverage_filter(_clear_raster(t), ["tile_id", "obs_date"], "clear_red", 75).select("tile_id", "y", "x", "obs_date", "nir")


@query("valid_scenes", f"""
    SELECT pixel_id, {day('obs_date', 'obs_date')}, {r6('nir', 'nir')} FROM $px_series
    WHERE obs_date IN (SELECT obs_date FROM $px_series GROUP BY obs_date
                       HAVING SUM(CASE WHEN fmask & 30 = 0 AND nir < 0.2 THEN 1 ELSE 0 END) >= 0.1 * COUNT(*))""")
def valid_scenes(t):
    clear = t.px_series.withColumn("red", F.when((F.col("fmask").bitwiseAND(30) == 0) & (F.col("nir") < 0.2), F.col("red")))
    return quality.valid_scenes(clear, ["obs_date"]).select("pixel_id", "obs_date", "nir")


@query("valid_steps", f"""
    SELECT pixel_id, {day('obs_date', 'obs_date')}, {r6('red', 'red')}, {r6('nir', 'nir')} FROM $px_series
    WHERE (pixel_id, obs_date) IN (SELECT (pixel_id, obs_date) FROM $px_series GROUP BY pixel_id, obs_date HAVING MAX(ABS(red)) > 0)""")
def valid_steps(t):
    return quality.valid_steps(t.px_series, ["pixel_id", "obs_date"], "red").select("pixel_id", "obs_date", "red", "nir")


@query("empty_step_share", f"""
    SELECT pixel_id, COUNT(*) AS n_steps, {r6('AVG(CASE WHEN top = 0 THEN 1.0 ELSE 0 END)', 'empty_share')}
    FROM (SELECT pixel_id, obs_date, MAX(ABS(red)) AS top FROM $px_series GROUP BY 1, 2) GROUP BY pixel_id""")
def empty_step_share(t):
    return quality.empty_step_share(t.px_series, ["pixel_id"], ["obs_date"], "red")


_Z = "PARTITION BY pixel_id ORDER BY obs_date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING"


@query("rolling_zscore", f"""
    WITH d AS (SELECT pixel_id, obs_date, MAX(nir) AS nir FROM $px_series GROUP BY 1, 2),
         s AS (SELECT *, AVG(nir) OVER ({_Z}) AS mean, STDDEV_POP(nir) OVER ({_Z}) AS std FROM d)
    SELECT pixel_id, {day('obs_date', 'obs_date')}, {r6('(nir - mean) / NULLIF(std, 0)', 'z')}, {r6('mean', 'mean')}, {r6('std', 'std')},
           NOT COALESCE(ABS((nir - mean) / NULLIF(std, 0)) <= 2.2, FALSE) AS is_outlier,
           {r6('CASE WHEN COALESCE(ABS((nir - mean) / NULLIF(std, 0)) <= 2.2, FALSE) THEN nir ELSE mean END', 'repaired')} FROM s""")
def rolling_zscore(t):
    daily = t.px_series.groupBy("pixel_id", "obs_date").agg(F.max("nir").alias("nir"))
    return quality.rolling_zscore(daily, ["pixel_id"], "nir", 9, 2.2).drop("nir")


_ZB = "PARTITION BY tile_id ORDER BY obs_date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING"
_FLAG = lambda b: f"CASE WHEN COALESCE(ABS(({b} - AVG({b}) OVER ({_ZB})) / NULLIF(STDDEV_POP({b}) OVER ({_ZB}), 0)) <= 1.9, FALSE) THEN 0 ELSE 1 END"


@query("remove_anomalies", f"""
    WITH m AS (SELECT tile_id, obs_date, AVG(red) AS red, AVG(nir) AS nir, AVG(green) AS green FROM $px_raster GROUP BY 1, 2),
         f AS (SELECT tile_id, obs_date, {_FLAG('red')} + {_FLAG('nir')} + {_FLAG('green')} AS n FROM m)
    SELECT tile_id, y, x, {day('obs_date', 'obs_date')}, {r6('nir', 'nir')} FROM $px_raster r
    WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.tile_id = r.tile_id AND f.obs_date = r.obs_date AND n > 1)""")
def remove_anomalies(t):
    return quality.remove_anomalies(t.px_raster, ["tile_id"], ["red", "nir", "green"], 1.9, 9) \
        .select("tile_id", "y", "x", "obs_date", "nir")
