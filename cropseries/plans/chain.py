"""Named steps applied in order with their own parameters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import augment, bands, phenology, quality, raster, series, splits, timegrid

STEPS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (
        bands.scale_bands, bands.repair_scale, bands.valid_range, bands.fmask_mask, bands.vegetation_indices,
        bands.custom_index, bands.ndvi_guarded, bands.evi_values, bands.normalize_bands, bands.standard_scale,
        bands.minmax_scale, bands.fill_zero, bands.zero_to_null, bands.bands_long, bands.bands_wide,
        timegrid.day_offset, timegrid.time_window, timegrid.random_window, timegrid.latest_windows,
        timegrid.composite_nanmean, timegrid.composite_grid, timegrid.month_window_series, timegrid.daily_mean,
        timegrid.annual_median, timegrid.pad_dates,
        quality.coverage_filter, quality.valid_scenes, quality.valid_steps, quality.dedupe_dates,
        quality.rolling_zscore, quality.remove_anomalies,
        raster.crop_pad, raster.orient_y, raster.clip_bbox, raster.border_na, raster.centre_reduction,
        raster.align_grid, raster.hist_equalize, raster.sobel, raster.tile_pixels, raster.cut_patches,
        series.kernel_smooth, series.chen_sg, series.smooth_series,
        phenology.modal_class, phenology.cluster_curve, phenology.stage_median, phenology.biweekly_snap,
        phenology.suppress_rare, phenology.validate_phenology, phenology.check_phenology,
        splits.split_by_tile, splits.random_split, splits.subset,
        augment.flip, augment.affine_remap, augment.mask_times, augment.mask_blocks, augment.add_noise,
    )
}


def run_steps(df: DataFrame, steps: Sequence[str], params: Mapping[str, Mapping[str, object]] | None = None,
              extra: Mapping[str, Callable[..., DataFrame]] | None = None) -> DataFrame:
    """Apply ``steps`` in order; ``params[name]`` are the step's keyword arguments, ``extra`` adds own steps."""
    known = {**STEPS, **(extra or {})}
    unknown = [s for s in steps if s not in known]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")
    return reduce(lambda acc, name: acc.transform(known[name], **dict((params or {}).get(name, {}))), steps, df)
