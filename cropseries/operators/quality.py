"""Scene-level quality: coverage, empty steps, duplicates and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..relational import first_per_key, with_group_stats


def _with_share(df: DataFrame, scene: Sequence[str], band: str, alias: str) -> DataFrame:
    return with_group_stats(df, scene, F.avg(F.col(band).isNotNull().cast("double")).alias(alias))


def coverage_filter(df: DataFrame, scene: Sequence[str], band: str, min_percent: float) -> DataFrame:
    """Keep scenes with strictly more than ``min_percent`` of the band present."""
    return _with_share(df, scene, band, "_share").filter(F.col("_share") * 100 > min_percent).drop("_share")


def valid_scenes(df: DataFrame, scene: Sequence[str], band: str = "red", min_share: float = 0.10) -> DataFrame:
    return _with_share(df, scene, band, "_share").filter(F.col("_share") >= min_share).drop("_share")


def valid_steps(df: DataFrame, step: Sequence[str], band: str) -> DataFrame:
    """Drop time steps whose first band is zero everywhere."""
    filled = with_group_stats(df, step, F.bool_or(F.coalesce(F.col(band), F.lit(0.0)) != 0).alias("_any"))
    return filled.filter("_any").drop("_any")


def empty_step_share(df: DataFrame, group: Sequence[str], step: Sequence[str], band: str) -> DataFrame:
    steps = df.groupBy(*group, *step).agg(F.bool_or(F.coalesce(F.col(band), F.lit(0.0)) != 0).alias("_any"))
    return steps.groupBy(*group).agg(F.count("*").alias("n_steps"),
                                     F.avg((~F.col("_any")).cast("double")).alias("empty_share"))


def dedupe_dates(scenes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one scene per key (tile and date), the first in an explicit order."""
    return first_per_key(scenes, keys, order)


def rolling_zscore(df: DataFrame, keys: Sequence[str], value: str, window: int = 9, thresh: float = 2.5,
                   order: str = "obs_date") -> DataFrame:
    """Centred rolling z-score with population deviation and at least one row.

    Adds ``z``, ``mean``, ``std``, ``is_outlier`` and ``repaired`` (outliers replaced by the mean). A constant
    stretch has no z and is flagged. Expects one row per key and date, so a key is bounded by the calendar.
    """
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
    stats = df.withColumns({"mean": F.avg(value).over(frame), "std": F.stddev_pop(value).over(frame)})
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    flagged = stats.withColumn("z", z).withColumn("is_outlier", ~F.coalesce(F.abs("z") <= thresh, F.lit(False)))
    return flagged.withColumn("repaired", F.when(F.col("is_outlier"), F.col("mean")).otherwise(F.col(value)))


def anomalous_dates(df: DataFrame, keys: Sequence[str], bands: Sequence[str], thresh: float = 2.5, window: int = 9,
                    date: str = "obs_date") -> DataFrame:
    """Dates whose scene mean is an outlier in more than one band."""
    means = df.groupBy(*keys, date).agg(*[F.avg(b).alias(b) for b in bands])
    frame = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(window // 2), (window - 1) // 2)
    votes = F.lit(0)
    for b in bands:
        z = F.try_divide(F.col(b) - F.avg(b).over(frame), F.stddev_pop(b).over(frame))
        votes = votes + (~F.coalesce(F.abs(z) <= thresh, F.lit(False))).cast("int")
    return means.withColumn("n_flags", votes).filter(F.col("n_flags") > 1).select(*keys, date, "n_flags")


def remove_anomalies(df: DataFrame, keys: Sequence[str], bands: Sequence[str], thresh: float = 2.5, window: int = 9,
                     date: str = "obs_date") -> DataFrame:
    flagged = anomalous_dates(df, keys, bands, thresh, window, date)
    return df.join(flagged, [*keys, date], "left_anti")
