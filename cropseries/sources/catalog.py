"""Patch catalog and tile grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..relational import hash_ranked



def list_files(spark: SparkSession, path: str, pattern: str = "*.nc") -> DataFrame:
    """File names under a path from the metadata of a binary scan; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", "length", "modificationTime")


def patch_catalog(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Add ``tile_id`` and ``patch_id`` parsed from the file name."""
    at = F.instr(F.col(name), "patch_")
    tile = F.when(at > 7, F.substring(name, F.lit(1), at - 7))
    stop = F.length(name) - 3
    patch = F.when(at > 0, F.substring(name, at + 6, stop - at - 5))
    return files.withColumns({"tile_id": tile, "patch_id": patch})


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """Sorted unique values."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def tile_patch_combos(catalog: DataFrame) -> DataFrame:
    """All tile and patch pairs that have a file. Pairs come from the files themselves, so no product is formed."""
    return catalog.select("tile_id", "patch_id").filter(F.col("tile_id").isNotNull() & F.col("patch_id").isNotNull()).distinct()


def pending_tiles(tiles: DataFrame, done: DataFrame, on: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Tiles without output yet."""
    return tiles.join(done.select(*on), list(on), "left_anti")


def tile_grid(spark: SparkSession, bbox: DataFrame, cell: float) -> DataFrame:
    """Row-major lon/lat cells of a one-row bounding box (min_lon, min_lat, max_lon, max_lat)."""
    cols = F.floor((F.col("max_lon") - F.col("min_lon")) / F.lit(cell)).cast("int")
    rows = F.floor((F.col("max_lat") - F.col("min_lat")) / F.lit(cell)).cast("int")
    cells = (bbox.withColumns({"n_cols": cols, "n_rows": rows}).filter("n_cols > 0 AND n_rows > 0")
             .withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
             .withColumn("grid_col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))))
    edge = lambda low, i: F.col(low) + i * F.lit(cell)
    return cells.select((F.col("grid_row") * F.col("n_cols") + F.col("grid_col")).alias("cell_id"), "grid_row", "grid_col",
                        edge("min_lon", F.col("grid_col")).alias("min_lon"), edge("min_lat", F.col("grid_row")).alias("min_lat"),
                        edge("min_lon", F.col("grid_col") + 1).alias("max_lon"), edge("min_lat", F.col("grid_row") + 1).alias("max_lat"))


def bbox_frame(spark: SparkSession, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    return spark.range(1).select(F.lit(min_lon).alias("min_lon"), F.lit(min_lat).alias("min_lat"),
                                 F.lit(max_lon).alias("max_lon"), F.lit(max_lat).alias("max_lat"))


def tile_sample(grid: DataFrame, n: int, seed: int, id_column: str = "cell_id") -> DataFrame:
    """n cells without replacement (all of them if there are fewer), repeatable for a seed."""
    return hash_ranked(grid, [id_column], seed).filter(F.col("rank") <= n).drop("rank", "total")
