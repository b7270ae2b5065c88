"""From granules and their pixels to patches ready for training: one job over all tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import spectral
from ..operators import bands as band_ops, quality
from ..relational import join_null_safe
from ..sources import granules as sources


def ingest_patches(links: DataFrame, pixels: DataFrame, bands: Sequence[str], patch: int, factor: float = 1e-4, required: Sequence[str] = sources.REQUIRED_BANDS,
                   min_share: float = 0.10, bits: Sequence[int] = spectral.SCENE_BITS, quality_band: str | None = None) -> DataFrame:
    """Pixels of complete granules, scaled, masked and in range, of valid scenes, one scene per tile and date, with patch places.

    ``links``: ``granule_id``, ``product``, ``links``. ``pixels``: ``granule_id``, ``tile_id``, ``obs_date``, ``y``, ``x``,
    the bands and ``fmask``. A scene is a granule's part of a tile; of a tile's scenes on one date the one with the smallest
    granule id stays. Adds ``patch_row`` and ``patch_col``. Scene statistics are combining aggregates joined back.
    """
    complete = sources.complete_granules(sources.band_links(links), required)
    chosen = pixels.join(complete, "granule_id", "left_semi")
    clean = band_ops.valid_range(band_ops.fmask_mask(band_ops.scale_bands(chosen, bands, factor), bands, bits), bands)
    scenes = quality.valid_scenes(clean, ["tile_id", "obs_date", "granule_id"], quality_band or bands[0], min_share)
    first = scenes.groupBy("tile_id", "obs_date").agg(F.min("granule_id").alias("granule_id"))
    kept = join_null_safe(scenes, first, ["tile_id", "obs_date", "granule_id"], "left_semi")
    return kept.withColumns({"patch_row": F.floor(F.col("y") / patch).cast("int"), "patch_col": F.floor(F.col("x") / patch).cast("int")})


def write_patches(patches: DataFrame, path: str) -> None:
    """One folder per tile; a patch's rows lie together."""
    patches.repartition("tile_id", "patch_row", "patch_col").write.partitionBy("tile_id").parquet(path)
