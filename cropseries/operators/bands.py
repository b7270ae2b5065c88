"""Row-level band operators: scaling, masking, indices, encodings, wide/long layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spectral
from ..relational import with_group_stats


def _each(df: DataFrame, bands: Sequence[str], fn) -> DataFrame:
    return df.withColumns({b: fn(F.col(b)) for b in bands})


def scale_bands(df: DataFrame, bands: Sequence[str], factor: float | str = 1e-4) -> DataFrame:
    """Multiply by a constant or by a stored factor column, which then becomes 1."""
    if isinstance(factor, str):
        return _each(df, bands, lambda v: v * F.col(factor)).withColumn(factor, F.lit(1.0))
    return _each(df, bands, lambda v: v * F.lit(factor))


def repair_scale(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Values in (1, 100000) were left unscaled; values below -10 are a missing-value sentinel."""
    return _each(df, bands, lambda v: F.when((v > 1) & (v < 100000), v * 1e-4).when(v >= -10, v))


def valid_range(df: DataFrame, bands: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return _each(df, bands, lambda v: F.when(v.between(low, high), v))


def fmask_mask(df: DataFrame, bands: Sequence[str], bits: Sequence[int] = spectral.SCENE_BITS,
               quality: str = "fmask", blank_quality: bool = False) -> DataFrame:
    """NULL all bands where any chosen quality bit is set."""
    clear = spectral.is_clear(quality, bits)
    masked = {b: F.when(clear, F.col(b)) for b in bands}
    if blank_quality:
        masked[quality] = F.when(clear, F.col(quality))
    return df.withColumns(masked)


def vegetation_indices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: spectral.band_expression(spectral.INDEX_FORMULAS[n], df.columns) for n in names})


def custom_index(df: DataFrame, expression: str, label: str) -> DataFrame:
    return df.withColumn(label, spectral.band_expression(expression, df.columns))


def ndvi_guarded(df: DataFrame) -> DataFrame:
    """Add clipped NDVI and GNDVI where the table does not have them yet."""
    pairs = {"ndvi": ("nir", "red"), "gndvi": ("nir", "green")}
    return df.withColumns({n: spectral.guarded_ratio(a, b) for n, (a, b) in pairs.items() if n not in df.columns})


def evi_values(df: DataFrame, vi: str = "evi", eps: float = 1e-9, out: str = "vi") -> DataFrame:
    """Series value EVI or NDVI; an exact zero means missing."""
    if vi == "evi":
        value = spectral.evi(eps=eps)
    elif vi == "ndvi":
        value = F.try_divide(F.col("nir") - F.col("red"), F.col("nir") + F.col("red") + F.lit(eps))
    else:
        raise ValueError(f"unknown series index {vi!r}")
    return df.withColumn(out, F.nullif(value, F.lit(0.0)))


def normalize_bands(df: DataFrame, nbands: int = 7) -> DataFrame:
    """(v - mean) / std with fixed statistics; exact zeros and missing values stay 0, other columns untouched."""
    if nbands not in spectral.BAND_STATS:
        raise ValueError("fixed statistics exist for 5 or 7 bands only")
    return df.withColumns({b: F.coalesce(F.when(F.col(b) != 0, (F.col(b) - m) / s), F.lit(0.0))
                           for b, (m, s) in spectral.BAND_STATS[nbands].items()})


def _scaled(df: DataFrame, band: str, shift: Column, width: Column, navalue: float | None) -> DataFrame:
    v = F.col(band)
    scaled = F.try_divide(v - shift, width)
    if navalue == 0:
        scaled = F.coalesce(F.when(v != 0, scaled), F.lit(0.0))
    return df.withColumn(band, scaled)


def _statistics(df: DataFrame, keys: Sequence[str], aggregate: Column) -> tuple[DataFrame, Column]:
    if not keys:
        return df, df.agg(aggregate).scalar()
    return with_group_stats(df, keys, aggregate.alias("_stats")), F.col("_stats")


def standard_scale(df: DataFrame, band: str, mean: float | None = None, std: float | None = None,
                   navalue: float | None = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Z-scale with given or derived (population, zeros included) statistics.

    Derived ones are of the whole table (one scalar row), or of each image where ``keys`` name it.
    """
    df, stats = _statistics(df, keys, F.struct(F.avg(band).alias("m"), F.stddev_pop(band).alias("s")))
    return _scaled(df, band, F.lit(mean) if mean is not None else stats["m"],
                   F.lit(std) if std is not None else stats["s"], navalue).drop("_stats")


def minmax_scale(df: DataFrame, band: str, low: float | None = None, high: float | None = None,
                 navalue: float | None = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Scale to 0..1 with given or derived bounds, of the whole table or of each image that ``keys`` name."""
    df, stats = _statistics(df, keys, F.struct(F.min(band).alias("lo"), F.max(band).alias("hi")))
    lo = F.lit(low) if low is not None else stats["lo"]
    hi = F.lit(high) if high is not None else stats["hi"]
    return _scaled(df, band, lo, hi - lo, navalue).drop("_stats")


def fill_zero(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return _each(df, bands, lambda v: F.coalesce(v, F.lit(0.0)))


def zero_to_null(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return _each(df, bands, lambda v: F.nullif(v, F.lit(0.0)))


def bands_long(df: DataFrame, ids: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """One row per band."""
    return df.unpivot(list(ids), list(bands), "band", "value")


def bands_wide(df: DataFrame, ids: Sequence[str], bands: Sequence[str], name: str = "band",
               value: str = "value") -> DataFrame:
    """One column per band; the smallest value wins where a key repeats a band, so results are repeatable."""
    return df.groupBy(*ids).agg(*[F.min(F.when(F.col(name) == b, F.col(value))).alias(b) for b in bands])


def merge_bands(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Combine single-band tables on their coordinates (outer): one union and one grouping for any number of bands."""
    names = list(tables)
    aligned = None
    for name, table in tables.items():
        part = table.select(*keys, *[(F.col(n) if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        aligned = part if aligned is None else aligned.unionByName(part)
    return aligned.groupBy(*keys).agg(*[F.min(n).alias(n) for n in names])
