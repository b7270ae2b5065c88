"""Patches as tensors: packing of pixel rows, scoring by models that see neighbours, and unpacking to pixel rows.

A packed patch is one row: the image's keys, ``patch`` (row-major), ``n_values`` and ``tensor``, the little-endian numbers of its
slots x bands x rows x columns. Missing pixels and values, and the part of an edge patch beyond the image, are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of tensors that a model is given at once.
BATCH_BYTES = 32 << 20


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def pack_patches(df: DataFrame, keys: Sequence[str], bands: Sequence[str], size: int, steps: int, height: int, width: int,
                 slot: str = "slot", dtype: str = "<f4") -> DataFrame:
    """One row per image and patch, also where a patch has no pixel: see the module.

    Rows outside the image or the ``steps`` slots are left out; of repeated rows of a pixel and slot each band's largest value
    counts. They are folded in a combining aggregate first, so that the grouping by patch never sees more rows than a tensor
    has cells, however often a pixel was observed. Null keys are an image of their own.
    """
    across, down = math.ceil(width / size), math.ceil(height / size)
    shape = (steps, len(bands), size, size)
    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & F.col(slot).between(0, steps - 1)
    place = (F.floor(F.col("y") / size) * across + F.floor(F.col("x") / size)).cast("int")
    cell = ((F.col(slot) * size + F.col("y") % size) * size + F.col("x") % size).cast("long")
    pixels = (df.filter(inside).groupBy(*keys, place.alias("patch"), cell.alias("_cell")).agg(*[F.max(F.col(b).cast("double")).alias(f"_b{k}") for k, b in enumerate(bands)]))
    every = df.select(*keys).distinct().withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))))
    stacked = pixels.unionByName(every, allowMissingColumns=True)
    schema = T.StructType([*_key_fields(df, keys), T.StructField("patch", T.IntegerType()), T.StructField("n_values", T.LongType()), T.StructField("tensor", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    n_keys = len(keys)

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(rows.column("_cell").is_valid())
        at, day = np.divmod(rows.column("_cell").to_numpy(), size * size)[::-1]
        tensor, n = np.zeros((steps, len(bands), size * size)), 0
        for k in range(len(bands)):
            values = rows.column(f"_b{k}").to_numpy()
            valid = ~np.isnan(values)
            tensor[day[valid], k, at[valid]] = values[valid]
            n += int(valid.sum())
        values = [*[k.as_py() for k in key[:n_keys + 1]], n, tensor.reshape(shape).astype(dtype).tobytes()]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    return stacked.groupBy(*keys, "patch").applyInArrow(fill, schema)


def score_patches(packed: DataFrame, fn: Callable[[np.ndarray, object], np.ndarray], keys: Sequence[str], shape: tuple[int, int, int, int],
                  model: object = None, batch_bytes: int = BATCH_BYTES, dtype: str = "<f4") -> DataFrame:
    """Keys, patch, scores, error: ``fn(tensors, model)`` maps n x slots x bands x rows x columns to n x classes x rows x columns.

    The model is broadcast once. A batch holds as many patches as ``batch_bytes`` admit, and one at least. A batch that fails is
    scored patch by patch, and patches that still fail, or whose tensor hasn't the given shape, have null scores and
    their message in ``error``. ``scores`` is binary, classes x rows x columns.
    """
    schema = T.StructType([*_key_fields(packed, [*keys, "patch"]), T.StructField("scores", T.BinaryType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)
    shared = packed.sparkSession.sparkContext.broadcast(model)
    size_of = np.dtype(dtype).itemsize * math.prod(shape)
    at_once = max(batch_bytes // size_of, 1)

    def attempt(tensors: list[bytes]) -> list[bytes]:
        stacked = np.stack([np.frombuffer(t, dtype).reshape(shape) for t in tensors])
        scores = np.asarray(fn(stacked, shared.value))
        if scores.ndim != 4 or len(scores) != len(tensors) or scores.shape[2:] != shape[2:]:
            raise ValueError(f"the model gave scores of the shape {scores.shape}")
        return [s.astype(dtype).tobytes() for s in scores]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                tensors = part.column(part.num_columns - 1).to_pylist()
                errors: list[str | None] = [None] * len(tensors)
                try:
                    scores: list[bytes | None] = list(attempt(tensors))
                except Exception:
                    scores = []
                    for i, tensor in enumerate(tensors):
                        try:
                            scores += attempt([tensor])
                        except Exception as exc:
                            scores.append(None)
                            errors[i] = f"{type(exc).__name__}: {exc}"
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.binary()), pa.array(errors, pa.string())], schema=arrow)

    return packed.select(*keys, "patch", "tensor").mapInArrow(score, schema)


def unpack_scores(scored: DataFrame, keys: Sequence[str], size: int, height: int, width: int, dtype: str = "<f4") -> DataFrame:
    """Pixel rows of scored patches: keys, y, x in the image, scores (one per class), class (of the largest, the first of equals).

    Pixels beyond the image don't come out; neither do patches without scores, which ``scored`` lists with their errors."""
    across = math.ceil(width / size)
    schema = T.StructType([*_key_fields(scored, keys), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()),
                           T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("class", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    n_keys = len(keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                patch = row.column(n_keys)[0].as_py()
                planes = np.frombuffer(row.column(n_keys + 1)[0].as_py(), dtype).reshape(-1, size * size).T.astype(float)
                y, x = np.divmod(np.arange(size * size), size)
                y, x = y + patch // across * size, x + patch % across * size
                keep = (y < height) & (x < width)
                planes, n = planes[keep], int(keep.sum())
                scores = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * planes.shape[1], pa.int32()), pa.array(planes.ravel()))
                columns = [row.column(k).take(pa.array(np.zeros(n, np.int64))) for k in range(n_keys)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(y[keep], pa.int32()), pa.array(x[keep], pa.int32()), scores.cast(arrow.field("scores").type),
                                                  pa.array(planes.argmax(axis=1), pa.int32())], schema=arrow)

    return scored.filter(F.col("scores").isNotNull()).select(*keys, "patch", "scores").mapInArrow(spread, schema)


def score_images(df: DataFrame, fn: Callable[[np.ndarray, object], np.ndarray], keys: Sequence[str], bands: Sequence[str], size: int, steps: int,
                 height: int, width: int, model: object = None, slot: str = "slot", batch_bytes: int = BATCH_BYTES, dtype: str = "<f4") -> DataFrame:
    """Pixel rows to classes by a model over whole patches: pack, score and unpack."""
    packed = pack_patches(df, keys, bands, size, steps, height, width, slot, dtype)
    scored = score_patches(packed, fn, keys, (steps, len(bands), size, size), model, batch_bytes, dtype)
    return unpack_scores(scored, keys, size, height, width, dtype)
