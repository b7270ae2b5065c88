"""Batch scoring with a user-supplied model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.labels import argmax_class


def score_batches(df: DataFrame, fn: Callable[[np.ndarray, object], np.ndarray], features: str = "features",
                  ids: Sequence[str] = (), model: object = None, with_class: bool = True) -> DataFrame:
    """Apply ``fn(matrix, model) -> scores`` to Arrow batches of feature arrays.

    The model is broadcast once. A batch that fails is retried row by row, and rows that still fail keep
    NULL scores and their message in ``error``, so one bad patch does not stop the job.
    """
    id_fields = [f for f in df.schema.fields if f.name in ids]
    schema = T.StructType([*id_fields, T.StructField("scores", T.ArrayType(T.DoubleType())),
                           T.StructField("error", T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f.name for f in id_fields]

    def attempt(rows: Sequence[np.ndarray]) -> list[list[float]]:
        scores = np.asarray(fn(np.stack(rows).astype(float), shared.value), dtype=float)
        return [list(map(float, s)) for s in scores]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = batch[names].copy()
            rows = list(batch[features])
            errors: list[str | None] = [None] * len(rows)
            try:
                scores: list = attempt(rows) if rows else []
            except Exception:
                scores = []
                for i, row in enumerate(rows):
                    try:
                        scores.extend(attempt([row]))
                    except Exception as exc:
                        scores.append(None)
                        errors[i] = f"{type(exc).__name__}: {exc}"
            result["scores"], result["error"] = pd.Series(scores, index=batch.index, dtype=object), errors
            yield result

    scored = df.select(*names, features).mapInPandas(score, schema)
    return scored.withColumn("class", argmax_class("scores")) if with_class else scored
