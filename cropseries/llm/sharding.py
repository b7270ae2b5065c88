"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table
from .common import running_sums


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: every lane jumps ahead until it would pass the last shard, so about ln(shards) rounds."""
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a 64-bit key column; no ring table, no state."""
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards))

    return of(key)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The key is a stable 64-bit hash of the id, so id and shard count alone decide the shard. With one more shard
    (``grown_shard``) a row stays where it is or moves to the new shard. Slots number the rows of a shard by id, from 0,
    without gaps; they come from range-sorted running counts, so no shard passes through one task.

    A null text has no bytes; rows with a null id share one key. Rows that repeat an id land in the same shard and take
    slots by size and checksum. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.xxhash64(F.col("id"))
    rows = written_table(rows.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)}), "shards")
    slotted = running_sums(rows, ["shard"], ["id", "size", "text_crc32"], {"slot": F.lit(1)})
    return slotted.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
