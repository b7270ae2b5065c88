"""Land-cover maps: from observations to one class per pixel and month, for all tiles in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import spectral
from ..operators import bands as band_ops, scoring, timegrid
from ..relational import join_null_safe


def monthly_features(observations: DataFrame, keys: Sequence[str], bands: Sequence[str], scales: dict[str, tuple[float, float]],
                     bits: Sequence[int] = spectral.SCENE_BITS, date: str = "obs_date") -> DataFrame:
    """Cloud-masked monthly means of each pixel, normalised, with the pixel's annual medians: keys, ``month``, ``features``.

    ``scales``: (mean, deviation) per band. A band without a clear observation in a month is 0, as everywhere in
    composites. ``month`` is its first day. The monthly grouping combines on the map side; the medians run over its
    rows, at most one per pixel and month, so a pixel with very many observations loads no task.
    """
    clear = band_ops.fmask_mask(observations, bands, bits).withColumn("month", F.trunc(date, "month"))
    monthly = clear.groupBy(*keys, "month").agg(*[F.avg(b).alias(b) for b in bands])
    scaled = monthly.withColumns({b: F.coalesce((F.col(b) - scales[b][0]) / scales[b][1], F.lit(0.0)) for b in bands})
    medians = timegrid.annual_median(scaled, [*keys, F.year("month").alias("_year")], bands).withColumnsRenamed({b: f"_m_{b}" for b in bands})
    both = join_null_safe(scaled.withColumn("_year", F.year("month")), medians, [*keys, "_year"])
    return both.select(*keys, "month", F.array(*bands, *[f"_m_{b}" for b in bands]).alias("features"))


def class_map(observations: DataFrame, keys: Sequence[str], bands: Sequence[str], scales: dict[str, tuple[float, float]],
              score: Callable[[np.ndarray, object], np.ndarray], model: object, bits: Sequence[int] = spectral.SCENE_BITS) -> DataFrame:
    """Class of every pixel and month by the highest score; ``error`` tells why a pixel has none.

    Pixels are scored in Arrow batches with the model broadcast once, whatever tile they belong to.
    """
    features = monthly_features(observations, keys, bands, scales, bits)
    return scoring.score_batches(features, score, "features", [*keys, "month"], model).select(*keys, "month", "class", "error")


def write_class_maps(maps: DataFrame, path: str, tile: str = "tile_id") -> None:
    """One folder per tile and month."""
    maps.repartition(tile, "month").write.partitionBy(tile, "month").parquet(path)
