"""Repeatable training/validation splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..relational import first_by_hash, hash_ranked, join_null_safe


def split_by_tile(df: DataFrame, tile: str = "tile_id", share: float = 0.15, seed: int = 123) -> DataFrame:
    """int(n * share) whole tiles go to validation, the rest to training; the two are disjoint."""
    ranked = hash_ranked(df.select(tile).distinct(), [tile], seed)
    held_out = ranked.select(tile, F.when(F.col("rank") <= F.floor(F.col("total") * share), F.lit("validation"))
                             .otherwise(F.lit("training")).alias("split"))
    # the number of tiles is small beside the rows; a NULL tile is one of them
    return join_null_safe(df, held_out, [tile])


def random_split(df: DataFrame, ids: Sequence[str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """max(1, int(n * share)) rows to validation, the rest to training. ``ids`` identify a row."""
    held_out = first_by_hash(df, ids, seed, lambda n: F.greatest(F.lit(1), F.floor(n * share)))
    return df.withColumn("split", F.when(held_out, F.lit("validation")).otherwise(F.lit("training")))


def subset(df: DataFrame, ids: Sequence[str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """Sample of int(n * share) rows without replacement."""
    return df.filter(first_by_hash(df, ids, seed, lambda n: F.floor(n * share)))
