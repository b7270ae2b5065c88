"""Raster tables, mosaics and the metrics log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.quadtree import morton


def write_raster(df: DataFrame, path: str, tile: str = "tile_id", files_per_tile: int = 1, mode: str = "append") -> None:
    """Compressed Parquet partitioned by tile; sorted by row so that clips prune row groups.

    ``files_per_tile`` spreads tiles that are too large for one task.
    """
    spread = F.pmod(F.xxhash64("y", "x"), F.lit(files_per_tile))
    (df.repartition(F.col(tile), spread).sortWithinPartitions(tile, "y", "x")
     .write.mode(mode).option("compression", "zstd").partitionBy(tile).parquet(path))


def write_raster_by_place(df: DataFrame, path: str, tile: str = "tile_id", files: int | None = None, group_bytes: int = 1 << 20, mode: str = "append") -> None:
    """Parquet partitioned by tile, its rows along a space-filling curve of (y, x), so that a box in x *and* y prunes files and row groups.

    Pixels near each other in both directions have near Morton codes. The rows are range-partitioned by tile and code into ``files`` parts
    (by default the shuffle partitions), so a tile of any size is spread over many tasks, and sorted within; row groups of about
    ``group_bytes`` then cover small squares, which the scan tells by their least and greatest x and y. Coordinates are whole
    numbers; pixels with none or negative ones come first and are kept.
    """
    code = F.coalesce(F.when((F.col("x") >= 0) & (F.col("y") >= 0), morton(F.col("x"), F.col("y"))), F.lit(-1))
    order = [F.col(tile), code, F.col("y"), F.col("x")]
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd")
     .option("parquet.block.size", str(group_bytes)).option("parquet.block.size.row.check.min", "100").partitionBy(tile).parquet(path))


def read_raster(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a raster table; with a schema, its column order is restored (partition columns otherwise come last)."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


class MosaicConflict(ValueError):
    """Two tiles disagree on a cell."""


def mosaic_conflicts(parts: Sequence[DataFrame], keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Cells that hold two different values for a band."""
    cells = _cells(parts, keys, bands)
    differ = F.lit(False)
    for b in bands:
        differ = differ | F.coalesce(F.col(f"_lo_{b}") != F.col(f"_hi_{b}"), F.lit(False))
    return cells.filter(differ).select(*keys)


def _cells(parts: Sequence[DataFrame], keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    union = parts[0].select(*keys, *bands)
    for part in parts[1:]:
        union = union.unionByName(part.select(*keys, *bands))
    return union.groupBy(*keys).agg(*[a for b in bands for a in (F.min(b).alias(f"_lo_{b}"), F.max(b).alias(f"_hi_{b}"))])


def mosaic(parts: Sequence[DataFrame], keys: Sequence[str], bands: Sequence[str], on_conflict: str = "error") -> DataFrame:
    """Outer union of partial results by coordinate; equal or missing values merge.

    A cell with two different values fails the job while it is computed (``error``) or is left out of the
    result (``drop``, for reports together with ``mosaic_conflicts``).
    """
    cells = _cells(parts, keys, bands)
    same = F.lit(True)
    for b in bands:
        same = same & F.coalesce(F.col(f"_lo_{b}") == F.col(f"_hi_{b}"), F.lit(True))
    if on_conflict == "error":
        fail = F.raise_error(F.concat(F.lit("conflicting values at "), F.to_json(F.struct(*keys)))).cast("double")
        return cells.select(*keys, *[F.when(same, F.col(f"_lo_{b}")).otherwise(fail).alias(b) for b in bands])
    return cells.filter(same).select(*keys, *[F.col(f"_lo_{b}").alias(b) for b in bands])


def append_metrics(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append log rows as JSON; a column that is not a registered key is an error."""
    unknown = sorted(set(rows.columns) - set(keys))
    if unknown:
        raise KeyError(f"keys not in the log: {unknown}")
    rows.write.mode("append").json(path)


def load_metrics(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
