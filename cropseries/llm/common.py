"""Helpers shared by the text operators: ordered running sums, dense count tables, batch slicing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..session import written_table

#: What counts as white space between words everywhere here.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of one slice of a dense count table on its way through the shuffle.
SLICE = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null. Every run of characters that are not white space is one word."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(trimmed, SPACE, "")).cast("long")


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add, for each entry ``name: value`` of ``sums``, the sum of ``value`` over the row's predecessors in ``order``.

    ``group`` restarts the sums; ``order`` (nulls last) must tell rows apart as far as their order matters. The rows are
    range-sorted by group and order into a written table, so one group of any size is spread over many parts. Each part's
    total is added up over the parts before it; a part begins and ends at most one group, so at most two rows per part
    belong to groups that cross parts, and only those are broadcast.
    """
    group, order, names = list(group), list(order), list(sums)
    n = partitions(df.sparkSession)
    ranged = (df.withColumns({f"_v_{k}": v.cast("long") for k, v in sums.items()})
              .repartitionByRange(n, *order_columns([*group, *order])).withColumn("_part", F.spark_partition_id()))
    ranged = written_table(ranged, "ranged")
    totals = ranged.groupBy(*group, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    every = Window.partitionBy(*group)
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (totals.withColumns({"_first": F.min("_part").over(every)} | {f"_o_{k}": F.sum(f"_t_{k}").over(before) for k in names})
                .filter(F.col("_part") > F.col("_first"))
                .select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), *[f"_o_{k}" for k in names]))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy("_part", *group).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in names})
    joined = summed.join(F.broadcast(crossing), same, "left")
    return joined.select(*df.columns, *[(F.col(f"_w_{k}") + F.coalesce(f"_o_{k}", F.lit(0))).alias(k) for k in names])


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``limit`` bytes of text, and one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    groups = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, empty for null."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()
    return [v or b"" for v in values]


def dense_rows(counts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """A dense count table as rows (slice, salt, counts), without the slices that are all zero."""
    for k in range(0, len(counts), SLICE):
        part = counts[k:k + SLICE]
        if part.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()), "salt": pa.array([salt], pa.int32()),
                                              "counts": pa.array([part.astype("<i8").tobytes()], pa.binary())})


DENSE = "slice int, salt int, counts binary"


def dense_total(slices: DataFrame, size: int) -> np.ndarray:
    """Add up dense tables of ``size`` numbers that tasks emitted with :func:`dense_rows`.

    Added in two levels (per slice and salt, then per slice), so that no task holds the slices of all tasks. The sum has
    a fixed size, whatever the input, and is what reaches the driver.
    """
    def add(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b, "<i8") for b in t.column("counts").to_pylist()], axis=0, dtype=np.int64)
        return pa.table({"slice": t.column("slice")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    level = slices.groupBy("slice", "salt").applyInArrow(add, DENSE)
    out = np.zeros(size, dtype=np.int64)
    for row in level.groupBy("slice").applyInArrow(add, DENSE).collect():
        part = np.frombuffer(row["counts"], "<i8")
        out[row["slice"] * SLICE:row["slice"] * SLICE + len(part)] = part
    return out


def task_salt(salts: int = 64) -> int:
    from pyspark import TaskContext
    context = TaskContext.get()
    return (context.partitionId() if context else 0) % salts


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that ``columns`` doesn't hold."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name

