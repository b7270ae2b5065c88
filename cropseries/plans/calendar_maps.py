"""Crop-calendar maps for all tiles and month windows in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import labels, spectral
from ..operators import bands, matching, phenology, series, timegrid
from ..relational import join_null_safe, spread
from ..session import written_table

BANDS = ("blue", "red", "nir")


def vi_array(df: DataFrame, eps: float = 1e-9, out: str = "vi") -> DataFrame:
    """EVI per slot from the band arrays; an exact zero (an empty slot) is missing."""
    zipped = F.arrays_zip(*[F.col(b).alias(b) for b in BANDS])
    value = lambda p: F.nullif(F.try_divide((p["nir"] - p["red"]) * 2.5,
                                            p["nir"] + p["red"] * 6.0 - p["blue"] * 7.5 + 1.0 + eps), F.lit(0.0))
    return df.withColumn(out, F.transform(zipped, value)).drop(*BANDS)


def crop_pixels(class_map: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per pixel: modal class and crop flag over the months."""
    return phenology.modal_class(class_map, keys)


def smoothed_series(observations: DataFrame, keys: Sequence[str], end, n_windows: int, n_months: int = 6,
                    days: int = 14, bits: Sequence[int] = spectral.SCENE_BITS,
                    pixels: DataFrame | None = None) -> DataFrame:
    """Mask, composite every month window, EVI, smooth: one row per pixel and window."""
    masked = bands.fmask_mask(observations, BANDS, bits)
    windows = timegrid.month_window_series(masked, keys, BANDS, end, n_windows, n_months, days, pixels=pixels)
    return series.smooth_series(vi_array(windows), crop=None)


def modal_crop(codes: DataFrame, pixels: DataFrame, keys: Sequence[str], image: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Most frequent crop code of each pixel over the kept windows of its image, and those windows.

    ``codes``: keys, ``window_end``, ``crop_code`` of the matched pixels. A window is kept if any pixel of the image has a
    code other than 0 in it. A pixel without a match in a kept window counts as 0 there, so the zeros are the windows
    left over; the smallest code wins ties. Pixels that are no crop have 0.
    """
    found = codes.filter(F.col("crop_code") != 0)
    kept = found.select(*image, "window_end").distinct()
    n_kept = kept.groupBy(*image).agg(F.count("*").alias("_kept"))
    votes = found.groupBy(*keys, "crop_code").agg(F.countDistinct("window_end").alias("_n"))
    best = votes.groupBy(*keys).agg(F.sum("_n").alias("_matched"), F.max(F.struct("_n", (-F.col("crop_code")).alias("c"))).alias("_best"))
    joined = join_null_safe(join_null_safe(pixels.select(*keys), best, keys, "left"), n_kept, image, "left")
    zeros = F.coalesce("_kept", F.lit(0)) - F.coalesce("_matched", F.lit(0))
    code = F.when(F.col("_best._n") > zeros, -F.col("_best.c")).otherwise(0).cast("int")
    return joined.select(*keys, code.alias("crop_code")), kept


def _calendar_map(days: DataFrame, pixels: DataFrame, keys: Sequence[str], image: Sequence[str]) -> DataFrame:
    """Median day per pixel and stage over the kept windows, snapped to two weeks, rare days removed; modal crop code.

    Every pixel of the image takes part (with no day where nothing was found), so the rare-value share
    is of the whole image.
    """
    # read for the windows, the crop codes and the medians: stored so that the curves and fits behind it run once
    days = written_table(days.select(*keys, "window_end", "stage", "doy", "crop_code"), "calendar-stages")
    crops, kept = modal_crop(days, pixels, keys, image)
    blank = pixels.select(*keys, F.explode(F.array(*[F.lit(s) for s in labels.STAGES])).alias("stage"),
                          F.lit(None).cast("int").alias("doy"))
    stacked = join_null_safe(days, kept, [*image, "window_end"], "left_semi").select(*keys, "stage", "doy").unionByName(blank)
    # dealt by the rows, not by their well-packed bytes, since a median sorts its task's rows
    stacked = spread(stacked, *keys, "stage", rows=days.count())
    per_pixel = stacked.groupBy(*keys, "stage").agg(F.median(F.nullif(F.col("doy"), F.lit(0))).alias("doy"))
    snapped = phenology.suppress_rare(phenology.biweekly_snap(per_pixel), [*image, "stage"])
    return join_null_safe(snapped, crops, keys)


def phenology_pixels(observations: DataFrame, class_map: DataFrame, references: DataFrame, end, n_windows: int,
                     keys: Sequence[str] = ("tile_id", "y", "x"), image: Sequence[str] = ("tile_id",),
                     threshold: float = 0.50, zero_is_missing: bool = True) -> DataFrame:
    """Crop-calendar map per pixel: crop mask, window curves, nearest reference, shape fit, dates, medians.

    Non-crop pixels leave before the windows are expanded, so the smoothing and the fit see crop pixels only.
    """
    keys = list(keys)
    pixels = crop_pixels(class_map, keys)
    crops = pixels.filter(F.col("crop_mask") == 1).select(*keys)
    curves = smoothed_series(observations, keys, end, n_windows, pixels=crops)
    matched = matching.nearest_reference(curves, [*keys, "window_end"], references, threshold,
                                         ["ref_vi", "phen_days", "crop"])
    matched = matched.withColumn("crop_code", labels.crop_code("crop"))
    ids = [*keys, "window_end", "first_date", "crop_code"]
    validated = phenology.validate_stages(phenology.fit_stages(matched, ids), zero_is_missing)
    days = phenology.phenology_dates(phenology.stages_long(validated, ids))
    return _calendar_map(days, pixels, keys, image)


def phenology_clusters(observations: DataFrame, class_map: DataFrame, clusters: DataFrame, references: DataFrame, end,
                       n_windows: int, keys: Sequence[str] = ("tile_id", "y", "x"), image: Sequence[str] = ("tile_id",),
                       reference_threshold: float = 0.30, pixel_threshold: float = 0.30, drop_zero_rows: bool = True,
                       zero_is_missing: bool = True) -> DataFrame:
    """As ``phenology_pixels``, but curves are matched and fitted per cluster; pixels take their nearest cluster's dates.

    ``clusters``: pixel keys and ``cluster_id``. Cluster curves are few, so the fit runs on a tiny table.
    ``drop_zero_rows`` leaves all-zero curves out of the medians; ``zero_is_missing`` chooses the plausibility rules
    (``validate_phenology`` if set, else ``check_phenology``).
    """
    keys, image = list(keys), list(image)
    pixels = crop_pixels(class_map, keys)
    crops = pixels.filter(F.col("crop_mask") == 1).select(*keys)
    # read three times below (bracket, median, pixel match), so the curves are stored once
    curves = written_table(smoothed_series(observations, keys, end, n_windows, pixels=crops), "curves")
    group = [*image, "window_end"]
    labelled = curves.join(clusters, keys)
    medians = phenology.cluster_curve(labelled.select(*group, "cluster_id", "vi"), [*group, "cluster_id"],
                                      drop_zero_rows=drop_zero_rows)
    cluster_vi = phenology.curve_arrays(medians, [*group, "cluster_id"])
    matched = matching.nearest_reference(cluster_vi, [*group, "cluster_id"], references, reference_threshold,
                                         ["ref_vi", "phen_days", "crop"])
    fitted = phenology.fit_stages(matched.withColumn("crop_code", labels.crop_code("crop"))
                                  .withColumn("cluster_vi", F.col("vi")),
                                  [*group, "cluster_id", "cluster_vi", "crop_code"])
    validated = phenology.validate_stages(fitted, zero_is_missing)
    taken = matching.pixel_cluster_match(curves, validated, group, pixel_threshold)
    ids = [*keys, "window_end", "first_date", "crop_code"]
    days = phenology.phenology_dates(phenology.stages_long(taken, ids))
    return _calendar_map(days, pixels, keys, image)
