"""Curve smoothing on array columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import smoothing


def kernel_smooth(df: DataFrame, vi: str = "vi", days: str = "days", bandwidth: float = 0.03) -> DataFrame:
    return df.withColumn(vi, smoothing.kernel_regression(days, vi, bandwidth))


def chen_sg(df: DataFrame, vi: str = "vi", first: tuple[int, int] = (11, 7), second: tuple[int, int] = (3, 2),
            iterations: int = 10) -> DataFrame:
    """Envelope filter; incomplete curves come out as arrays of NULL."""
    return df.withColumn(vi, smoothing.chen_sg(vi, first, second, iterations))


def smooth_series(df: DataFrame, crop: str | None = "is_crop", vi: str = "vi", days: str = "days",
                  bandwidth: float = 0.03) -> DataFrame:
    """Kernel regression, then the envelope filter, for crop pixels; other or missing values become 0.

    Curves of other pixels are emptied before they are sent to the smoother, so they cost nothing; without a
    crop column every curve is smoothed. No join is needed.
    """
    if crop is None:
        return df.withColumn(vi, smoothing.smooth_curve(days, vi, bandwidth))
    wanted = F.coalesce(F.col(crop), F.lit(False))
    none = F.array().cast("array<double>")
    smoothed = smoothing.smooth_curve(F.when(wanted, F.col(days)).otherwise(none), F.when(wanted, F.col(vi)).otherwise(none), bandwidth)
    return df.withColumn("_smooth", smoothed).withColumn(
        vi, F.when(wanted, F.col("_smooth")).otherwise(F.array_repeat(F.lit(0.0), F.size(vi)))).drop("_smooth")
